"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# ---- personal data: each kind as (name, pattern, condition on the match, score, context words)

OCTET = r"0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
DOUBLED = f"list_transform(range(len({DIGITS})), lambda i: CAST(substr(reverse({DIGITS}), CAST(i AS INT) + 1, 1) AS INT) * (1 + i % 2))"
LUHN = f"list_sum(list_transform({DOUBLED}, lambda d: d - CASE WHEN d > 9 THEN 9 ELSE 0 END)) % 10 = 0"
PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 80, "email|e-mail|mail|contact|write"),
    (
        "ip",
        r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        rf"regexp_full_match(hit, '{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}')",
        60,
        "ip|address|host|server",
    ),
    ("card", r"[0-9](?:[ -]?[0-9])+", f"len({DIGITS}) BETWEEN 16 AND 19 AND {LUHN}", 70, "card|credit|visa|pay"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"len({DIGITS}) BETWEEN 8 AND 15", 60, "phone|call|tel|mobile|fax"),
)

PII_PIECES = " UNION ALL ".join(
    rf"""SELECT {i} AS kind_no, '{name}' AS kind, doc_id, {score} AS score, '\b(?:{words})\b' AS words,
    unnest(range(1, len(g) + 1)) AS n, unnest(g) AS gap, unnest(h) AS hit, text
    FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '([\s\S]*?)({pattern})', 1) AS g,
          regexp_extract_all(coalesce(text, ''), '([\s\S]*?)({pattern})', 2) AS h FROM documents)"""
    for i, (name, pattern, _, score, words) in enumerate(PII)
)
PII_HOLDS = " ".join(f"WHEN '{name}' THEN {holds}" for name, _, holds, _, _ in PII)

OP1 = rf"""
WITH pieces AS ({PII_PIECES}),
placed AS (SELECT *, sum(len(gap) + len(hit)) OVER (PARTITION BY kind_no, doc_id ORDER BY n) AS stop FROM pieces),
good AS (
  SELECT doc_id, kind_no, kind, stop - len(hit) AS start, stop, score + CASE WHEN regexp_matches(
      lower(substring(text, CAST(greatest(stop - len(hit) - 39, 1) AS BIGINT), CAST(least(stop - len(hit), 40) AS BIGINT))
        || chr(10) || substring(text, CAST(stop + 1 AS BIGINT), 40)), words) THEN 20 ELSE 0 END AS score
  FROM placed WHERE hit IS NOT NULL AND CASE kind {PII_HOLDS} END
),
spans AS (
  SELECT doc_id, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY kind_no, start) AS spans,
    string_agg(CAST(score AS VARCHAR), ',' ORDER BY kind_no, start) AS scores,
    count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
    count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone
  FROM good GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(scores, '') AS scores
FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id
"""

OP2 = rf"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
  FROM cut
),
each AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (SELECT x, y FROM common WHERE 100 * c >= 75 * (n + m - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(y), s.doc_id)) AS component_id,
  least(s.doc_id, coalesce(min(y), s.doc_id)) = s.doc_id AS kept
FROM sets s LEFT JOIN reach r ON s.doc_id = r.x GROUP BY s.doc_id, shingles
"""

OP3 = f"""
WITH t AS (SELECT doc_id, {LOWER} AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM t WINDOW same AS (PARTITION BY text)
"""

# ---- mixing: the same tree, weights, budget and order as the registered query, written out

DOMAIN = (
    "CASE WHEN right(coalesce(source, ''), 1) IN ('0', '1', '2', '3') THEN 'web'"
    " WHEN right(coalesce(source, ''), 1) IN ('4', '5', '6') THEN 'reference' ELSE 'forum' END"
)
WEIGHT = {
    "domain": "CASE domain WHEN 'web' THEN 5 WHEN 'reference' THEN 3 ELSE 2 END",
    "language": "CASE language WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END",
    "source": "1",
}


def _level(name: str, parents: list[str], given: str, joined: str) -> str:
    keys = ", ".join([*parents, name])
    within = f"PARTITION BY {', '.join(parents)}" if parents else ""
    order = f"{within} ORDER BY cap / weight, {name}"
    return f"""
{name}_nodes AS (SELECT n.*, {given} AS given FROM (SELECT {keys}, CAST(sum(cap) AS BIGINT) AS cap,
  CAST({WEIGHT[name]} AS BIGINT) AS weight FROM caps GROUP BY {keys}) n {joined}),
{name}_marked AS (SELECT *, cap * sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= (given - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS filled
  FROM {name}_nodes),
{name}_parts AS (SELECT *, given - coalesce(sum(cap) FILTER (filled) OVER ({within}), 0) AS rest,
  sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({within}) AS whole,
  sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS upto FROM {name}_marked),
{name}_given AS (SELECT {keys}, CAST(CASE WHEN filled THEN cap ELSE
  (CAST(rest AS BIGINT) * CAST(upto AS BIGINT)) // CAST(whole AS BIGINT)
  - (CAST(rest AS BIGINT) * CAST(upto - weight AS BIGINT)) // CAST(whole AS BIGINT) END AS BIGINT) AS target FROM {name}_parts)"""


OP5 = rf"""
WITH sizes AS (
  SELECT doc_id, {DOMAIN} AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
),
leaves AS (SELECT domain, language, source, CAST(sum(n_tokens) AS BIGINT) AS leaf_tokens FROM sizes WHERE n_tokens > 0 GROUP BY ALL),
caps AS (SELECT *, leaf_tokens * 2 AS cap FROM leaves),
total AS (SELECT CAST(least(sum(leaf_tokens), sum(cap)) AS BIGINT) AS given FROM caps),
{_level("domain", [], "t.given", ", total t")},
{_level("language", ["domain"], "g.target", "JOIN domain_given g USING (domain)")},
{_level("source", ["domain", "language"], "g.target", "JOIN language_given g USING (domain, language)")},
plan AS (SELECT l.*, target AS leaf_target, target // leaf_tokens AS whole, target % leaf_tokens AS rest
  FROM leaves l JOIN source_given USING (domain, language, source)),
ordered AS (SELECT s.*, leaf_tokens, leaf_target, whole, rest, md5('7:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM sizes s LEFT JOIN plan USING (domain, language, source)),
filled AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY key) AS upto FROM ordered)
SELECT doc_id, domain, language, source, n_tokens, coalesce(leaf_tokens, 0) AS leaf_tokens, coalesce(leaf_target, 0) AS leaf_target,
  CASE WHEN n_tokens > 0 THEN whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END ELSE 0 END AS copies
FROM filled
"""

OP8 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(replace(replace(role, '\', '\\'), ':', '\:'))
    + length(replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

# ---- lines: equal texts of a host are one document; counted per text, judged per row

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
NORMAL_LINE = r"""trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'),
  '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"""

OP13 = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
worded AS (SELECT doc_id, text, {WORDS} AS words FROM docs),
windows AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM worded)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM windows) WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM twice) GROUP BY doc_id),
lines AS (SELECT * FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
normal AS (SELECT doc_id, host, text, {NORMAL_LINE} AS line FROM lines),
often AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS n FROM normal GROUP BY ALL)
  JOIN (SELECT host, count(DISTINCT text) AS size FROM docs GROUP BY host) USING (host) WHERE n >= 20 AND n * 100 > size * 10),
lost AS (SELECT doc_id, CAST(sum(len(string_split(line, ' '))) AS BIGINT) AS lost_words
  FROM normal JOIN often USING (host, line) GROUP BY doc_id),
counts AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_words, 0) AS lost_words
  FROM worded LEFT JOIN dups USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, NOT base_failed AND lost_words * 100 <= n_words * 50 AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
"""

# ---- phrases: all windows of one to four words, counted by language

OP12 = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
windows AS (SELECT lang, m, words, unnest(range(1, len(words) - m + 2)) AS i FROM worded, range(1, 5) sizes(m)),
f AS (SELECT lang, m, array_to_string(words[i:i + m - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS a FROM windows GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM worded GROUP BY lang),
candidates AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS words FROM f WHERE m > 1 AND a >= 30),
cuts AS (SELECT *, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
scored AS (SELECT c.lang, c.phrase, c.a, k, h.a AS l, r.a AS r, 2000000 * c.a // (h.a + r.a) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, a, array_to_string(words[i:i + s - 1], ' ') AS phrase FROM (SELECT lang, a, words, s, unnest(range(1, m - s + 2)) AS i
  FROM (SELECT *, unnest(range(2, m)) AS s FROM candidates))),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_parts GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a,
  CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op1_pii": OP1,
    "op2_near_dedup": OP2,
    "op3_exact_dedup": OP3,
    "op5_mixing": OP5,
    "op8_chat": OP8,
    "op12_phrases": OP12,
    "op13_line_rules": OP13,
}

"""Operators against plain Python on small tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from climagest.llm import chat, quality
from climagest.llm.ann import Settings, nearest
from climagest.llm.bpe import Encoder, Prefixes
from climagest.llm.licenses import CONTAINED, TEMPLATES, plain, scan_licenses
from climagest.llm.near_dedup import near_duplicates
from climagest.llm.pii import pii_digest
from climagest.llm.queries import QUERIES
from climagest.llm.shingles import normal, shingle_set
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"
LINES = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, LINES.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def holds(kind: str, hit: str) -> bool:
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(part) <= 255 for part in hit.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


TRICKY = [
    "a.a@b.c_d@e.f",
    "a@b" + ".c" * 3000,
    "1.2.3.4.5.6.7.8.9 256.1.1.1 000001.2.3.4",
    "é😀 x@y.z 4111 1111 1111 1111 1",
    "+1 (2) 345-67.89 0 ++1+",
    "+1" + "(" * 3000,
    "x@y.z " * 500,
    "4111-1111-1111-1111 4111111111111112",
    "",
    None,
]


def test_personal_data(spark, documents):
    texts = TRICKY + [r.text for r in documents.select("text").limit(300).collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii_digest(rows).collect():
        found = [
            f"{kind}:{m.start()}:{m.end()}"
            for kind, pattern in PATTERNS.items()
            for m in re.finditer(pattern, texts[row.doc_id] or "")
            if holds(kind, m.group())
        ]
        assert row.base_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest(), texts[row.doc_id]


def test_added_kinds_and_context(spark):
    texts = ["my iban DE89 3704 0044 0532 0130 00.", "DE88370400440532013000", "ssn 123-45-6789", "123-45-6789", "mail a@b.c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.spans, r.scores) for r in pii_digest(rows).collect()}
    assert found == {0: ("iban:8:35", "100"), 1: ("", ""), 2: ("ssn:4:15", "60"), 3: ("", ""), 4: ("email:5:10", "100")}


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 300_000, "1" * 300_000, "@" * 100_000, "1-" * 100_000, "A1" * 100_000, ". " * 100_000 + "a@b.c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in pii_digest(rows).collect() if r.spans} == {5}


# ---- near duplicates


def components_of(texts: dict) -> dict:
    sets = {i: shingle_set(normal((t or "").encode())) for i, t in texts.items()}
    holders, root = collections.defaultdict(list), {i: i for i in texts}
    for i, shingles in sets.items():
        for shingle in shingles:
            holders[shingle].append(i)
    common = collections.Counter((a, b) for ids in holders.values() for a in ids for b in ids if a < b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates(documents):
    wanted = components_of({r.doc_id: r.text for r in documents.select("doc_id", "text").collect()})
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents).collect()}
    assert found == wanted


def test_families_whose_members_are_not_all_alike(spark):
    """Chains and stars of edits: links beside the hub have to be found too."""
    chance = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(260):
        words = list(base)
        for at in chance.sample(range(200), chance.randrange(0, 14)):
            words[at] = f"x{chance.randrange(40)}"
        texts[i] = " ".join(words)
    for i in range(260, 300):
        words = texts[i - 1].split()
        words[(7 * i) % 200 : (7 * i) % 200 + 2] = [f"y{i}"]
        texts[i] = " ".join(words)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(rows).collect()}
    assert found == components_of(texts)


# ---- byte-level BPE


def test_ids_are_those_of_the_public_library(documents, tokenizer):
    coder = Encoder(LINES, public_tokenizers.PATTERN)
    texts = [r.text for r in documents.select("text").limit(200).collect()]
    texts += ["", " " * 5000, "ab" * 3000, "\x1c\x85\u2028 \u3000x", "".join(map(chr, range(0x20, 0x3000)))]
    for text in texts:
        ids = coder.encode(text)
        assert ids.tolist() == tokenizer.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_appends_and_edits_are_exact():
    vocabulary, chance = Encoder(LINES, public_tokenizers.PATTERN).vocabulary, random.Random(3)
    data = b"thtionanwh the quick brown fox, \xc3\xa9\xe6\xbc\xa2 ....   again and again" * 6
    for _ in range(60):
        table = Prefixes(vocabulary, data)
        start = chance.randrange(len(data))
        stop, new = min(len(data), start + chance.randrange(9)), bytes(chance.choices(data, k=chance.randrange(7)))
        done = table.replace(start, stop, new)
        table.append(b"the end")
        wanted = data[:start] + new + data[stop:] + b"the end"
        assert table.data == wanted
        assert table.ids() == vocabulary.merged(wanted)
        assert done <= len(wanted)


def test_query_decodes_to_the_texts(spark, documents):
    found = {r.doc_id: r.decoded_sha256 for r in QUERIES["op7_bpe"](spark, FOLDER).collect()}
    rows = documents.select("doc_id", F.sha2("text", 256).alias("s")).collect()
    assert found == {r.doc_id: r.s for r in rows}


# ---- chats


def test_chats_read_back(spark):
    texts = ["", None, "\\", "</turn>\n### assistant: x</turn>\n", "\\</turn>", "a<", "### ", "#### é😀", "\\\\### "]
    chance = random.Random(1)
    rows = [(c, t, chance.choice(["user", "assistant", "a:b\\", None]), chance.choice(texts)) for c in range(40) for t in range(9)]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (3, 1, "user", "same"), (3, 1, "user", "same")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = collections.defaultdict(list)
    for r in chat.format_chats(frame).orderBy("part").collect():
        parts[r.conv_id].append(r)
    wanted = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: tuple((x is not None, x or type(x)()) if x is not None else (False,) for x in r)):
        wanted[c].append(((role or "").encode(), (text or "").encode()))
    for c, own in parts.items():
        assert [turn for p in own for turn in chat.read_turns(bytes(p.formatted))] == wanted[c]
        learned = [chat.unescaped(bytes(p.formatted)[a:b]) for p in own for a, b in zip(p.loss[::2], p.loss[1::2])]
        assert learned == [text for role, text in wanted[c] if role == b"assistant"]
    assert chat.chat_digest(frame).count() == 41
    assert chat.chat_digest(frame.where("false")).count() == 0


# ---- toxicity


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    scored = QUERIES["op9_toxicity"](spark, folder).where("held_out")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    counts = collections.Counter((r.toxic, r.predicted) for r in scored.join(labels, "doc_id").collect())
    assert counts[1, 1] >= 0.9 * (counts[1, 0] + counts[1, 1])
    assert counts[0, 1] <= 0.02 * (counts[0, 0] + counts[0, 1])


# ---- neighbours


def brute_neighbours(vectors: dict, queries: list, k: int) -> dict:
    found = {}
    for q in queries:
        a = np.array(vectors[q], float)
        scores = sorted(
            (-float(a @ np.array(v, float)) / float(np.linalg.norm(a) * np.linalg.norm(v)), i) for i, v in vectors.items() if i != q
        )
        found[q] = [i for _, i in scores[:k]]
    return found


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in rows.collect()}
    frame = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = collections.defaultdict(list)
    for r in nearest(frame, F.col("id") % 50 == 0, settings=Settings(list_size=20, probes=40)).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    wanted = brute_neighbours(vectors, [i for i in vectors if i % 50 == 0], 5)
    assert found.keys() == wanted.keys()
    hits = sum(len(set(found[q]) & set(wanted[q])) for q in wanted)
    assert hits >= 0.9 * sum(map(len, wanted.values()))


def test_copies_ties_and_unusable_vectors(spark):
    copies = [(i, [1.0, 2.0, 3.0]) for i in range(0, 300)]
    odd = [
        (1000, None),
        (1001, []),
        (1002, [0.0, 0.0, 0.0]),
        (1003, [1.0, None, 1.0]),
        (1004, [float("nan"), 1.0, 1.0]),
        (1005, [float("inf"), 1.0, 1.0]),
        (1006, [1.0, 2.0]),
        (None, [1.0, 2.0, 3.0]),
        (50, [1.0, 2.0, 3.0]),
        (1050, [-3.0, 1.0, 0.5]),
    ]
    frame = spark.createDataFrame(copies + odd, "id long, vector array<float>")
    found = collections.defaultdict(list)
    for r in nearest(frame, F.col("id") % 50 == 0, settings=Settings(block=64)).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert found == {
        **{q: [i for i in range(6) if i != q][:5] for q in range(0, 300, 50)},
        1050: [0, 1, 2, 3, 4],
    }
    assert nearest(frame.where("false"), F.col("id") % 50 == 0).count() == 0


# ---- licenses


def test_licenses_against_all_windows(spark, documents):
    words = [r.text for r in documents.select("text").limit(40).collect()]
    planted = [f"{w[:300]} {text} {w[300:900]}" for w, text in zip(words, [*TEMPLATES.values()] * 5)]
    changed = [t.replace("conditions are met", "terms are met").replace("any person", "every person") for t in planted]
    texts = [*words, *planted, *changed]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {name: shingle_set(plain(text.encode())) for name, text in TEMPLATES.items()}
    for row in scan_licenses(rows).collect():
        whole = shingle_set(plain(texts[row.doc_id].encode()))
        wanted = {name for name, own in sets.items() if len(own & whole) >= CONTAINED * len(own)}
        assert {x.license for x in row.licenses} == wanted


# ---- quality


def test_probabilities_of_every_context_add_up(spark):
    """The interpolated model is a distribution over the signs that follow any context."""
    texts = ["abracadabra", "alakazam abra", "banana bandana", "cab", "dab and dad", "a"] * 3 + ["abba", "zzz"]
    rows = spark.createDataFrame([(t.encode(), True) for t in texts], "text binary, trusted boolean")
    probabilities, rests = quality.kneser_ney(quality.gram_counts(rows))
    p = [{r.gram: r.p for r in level.collect()} for level in probabilities]
    rest = [{r.context: r.rest for r in level.collect()} for level in rests]

    def chance(context: tuple, sign: int) -> float:
        n = len(context) + 1
        gram = sum(c << quality.BITS * (n - 1 - i) for i, c in enumerate((*context, sign)))
        if gram in p[n - 1]:
            return p[n - 1][gram]
        left = rest[n - 1].get(gram >> quality.BITS, 1.0)
        return left * (chance(context[1:], sign) if context else 1 / (1 << quality.BITS))

    for context in ((ord("a"), ord("b")), (ord("z"),), (ord("q"), ord("a")), (1, 1, 1, ord("a")), ()):
        assert math.isclose(sum(chance(context, s) for s in range(1 << quality.BITS)), 1, rel_tol=1e-9), context
    logs = {r.gram: r.log_p for r in quality.log_probabilities(quality.gram_counts(rows)).collect()}
    for gram, value in logs.items():
        signs = [gram >> quality.BITS * (quality.ORDER - 1 - i) & (1 << quality.BITS) - 1 for i in range(quality.ORDER)]
        assert math.isclose(value, math.log(chance(tuple(signs[:-1]), signs[-1])), rel_tol=1e-9)


def test_shards_do_not_change_perplexities(spark, documents, monkeypatch):
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"), (F.col("doc_id") % 2 == 0).alias("trusted")).limit(60)
    logs = quality.log_probabilities(quality.gram_counts(rows))
    whole = {r.doc_id: r.perplexity for r in quality.perplexities(rows, logs, ["doc_id"]).collect()}
    monkeypatch.setattr(quality, "SHARD", 4000)
    for r in quality.perplexities(rows, logs, ["doc_id"]).collect():
        assert math.isclose(r.perplexity, whole[r.doc_id], rel_tol=1e-9)


# ---- pipeline


def test_pipeline_keeps_one_of_each_group(spark, documents):
    done = corpus_pipeline.run(spark, FOLDER)
    ids = {r.doc_id for r in done.select("doc_id").distinct().collect()}
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    kept = components_of({i: texts[i] for i in ids})
    assert all(component == i for i, (_, component) in kept.items())
    coder = Encoder(LINES, public_tokenizers.PATTERN)
    for r in done.select("doc_id", "tokens").limit(50).collect():
        assert coder.decode(np.array(r.tokens)) == texts[r.doc_id].encode()

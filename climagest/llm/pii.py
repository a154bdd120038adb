"""Personal data in texts, found with DataFrame expressions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and ranges confirm
them, and words shortly before or after a span raise its score.

A text is cut into pairs of a gap and a match, so that spans are running sums of
lengths. Every pattern is anchored at the end of the previous match and uses
possessive repeats: each text is read once per kind, however long it is, and the
matcher does not recurse.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before and after a span in which context words count.
CONTEXT = 40
#: Score, in hundredths, from which a span of a context-only kind is reported.
LEAST_SCORE = 50
CONTEXT_GAIN = 20
CHUNK = 128
#: Matches and gaps that are sure to fill a context: each match has two signs at least.
AROUND = CONTEXT // 2 + 1

OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Signs of an account number by country, from the public registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "|".join(
    rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}" for length, codes in IBAN_LENGTHS.items()
)
IP = r"^OCTET\.OCTET\.OCTET\.OCTET$".replace("OCTET", OCTET)


@dataclass(frozen=True)
class Kind:
    """How one kind of span is proposed, confirmed and scored."""

    name: str
    maybe: Callable[[Column], Column]
    pattern: str
    holds: Callable[[Column], Column]
    score: int
    words: str
    base: bool = True


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once instead of wherever it is named."""
    return F.transform(F.array(value), use)[0]


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def mod97(code: Column) -> Column:
    """Remainder of an account number, its first four signs moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))
    values = F.transform(F.split(moved, ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    return F.aggregate(
        F.filter(values, lambda v: v >= 0),
        F.lit(0),
        lambda rest, v: (rest * F.when(v > 9, 100).otherwise(10) + v) % 97,
    )


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def is_card(text: Column) -> Column:
    return bound(digits(text), lambda d: F.when(F.length(d).between(16, 19), F.call_function("luhn_check", d)).otherwise(False))


def is_iban(text: Column) -> Column:
    return bound(F.translate(text, " ", ""), lambda c: F.when(F.length(c).between(15, 34), mod97(c) == 1).otherwise(False))


def has(pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.rlike(text, F.lit(pattern))


KINDS = (
    Kind(
        "email",
        lambda text: F.contains(text, F.lit("@")),
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda text: F.lit(True),
        80,
        "email|e-mail|mail|contact|write",
    ),
    Kind(
        "ip",
        has(r"[0-9]\.[0-9]"),
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        has(IP),
        60,
        "ip|address|host|server",
    ),
    Kind("card", has(r"[0-9](?:[ -]?[0-9]){15}"), r"[0-9](?:[\x20-]?[0-9])++", is_card, 70, "card|credit|visa|pay"),
    Kind(
        "phone",
        lambda text: F.contains(text, F.lit("+")),
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda text: F.length(digits(text)).between(8, 15),
        60,
        "phone|call|tel|mobile|fax",
    ),
    Kind(
        "iban",
        has(r"[A-Z]{2}[0-9]{2}"),
        rf"(?:\G|(?<![A-Za-z0-9]))(?:{IBAN})",
        is_iban,
        80,
        "iban|account|bank",
        False,
    ),
    Kind(
        "ssn",
        has(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        r"(?:\G|(?<![0-9-]))[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        lambda text: ~F.rlike(text, F.lit("^(?:000|666|9[0-9]{2})|-00-|0000$")),
        40,
        "ssn|social|security",
        False,
    ),
)

SPAN = "array<struct<start:int,end:int,score:int>>"


def spans_of(text: Column, kind: Kind) -> Column:
    """Spans of one kind in a text that is not null: start and end in code points, score in hundredths."""
    pattern = r"\G([\s\S]*?)(" + kind.pattern + ")"

    def cut(gaps: Column, hits: Column, steps: Column, before: Column, after: Column) -> Column:
        chunks = F.aggregate(
            F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda acc, k: F.struct(
                (acc["at"] + total(F.slice(steps, k * CHUNK + 1, CHUNK))).alias("at"),
                F.concat(acc["all"], F.array(acc["at"])).alias("all"),
            ),
            lambda acc: acc["all"],
        )

        def one(first: Column, i: Column) -> Column:
            chunk = F.floor(i / CHUNK).cast("int")
            start = F.get(first, chunk) + total(F.slice(steps, chunk * CHUNK + 1, i % CHUNK)) + F.length(F.get(gaps, i))
            # what stands directly before and after the span, over as many neighbouring matches as it takes
            left = F.array_join(F.slice(before, F.greatest(i + 2 - AROUND, F.lit(1)), F.least(i + 1, F.lit(AROUND))), "")
            right = F.array_join(F.slice(after, i + 2, F.lit(AROUND)), "")
            near = F.concat_ws("\n", F.right(left, F.lit(CONTEXT)), F.left(right, F.lit(CONTEXT)))
            score = kind.score + F.when(F.rlike(F.lower(near), F.lit(rf"\b(?:{kind.words})\b")), CONTEXT_GAIN).otherwise(0)
            return F.struct(start.alias("start"), (start + F.length(F.get(hits, i))).alias("end"), score.alias("score"))

        good = lambda i: kind.holds(F.get(hits, i))
        kept = F.filter(F.sequence(F.lit(0), F.size(hits) - 1), good)
        found = bound(chunks, lambda first: F.transform(kept, lambda i: one(first, i)))
        return found if kind.base else F.filter(found, lambda s: s["score"] >= LEAST_SCORE)

    def pieces(gaps: Column) -> Column:
        def some(hits: Column) -> Column:
            # per match: the end of what lies between it and the match before, that match included
            earlier = F.concat(F.array(F.lit("")), hits)
            before = F.transform(gaps, lambda gap, i: F.right(F.concat(F.get(earlier, i), gap), F.lit(CONTEXT)))

            def stepped(steps: Column) -> Column:
                tail = F.substr(text, total(steps) + 1, F.lit(CONTEXT))
                after = F.concat(F.zip_with(gaps, hits, lambda g, h: F.left(F.concat(g, h), F.lit(CONTEXT))), F.array(tail))
                return bound(before, lambda b: bound(after, lambda a: cut(gaps, hits, steps, b, a)))

            return bound(F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h)), stepped)

        return F.when(F.size(gaps) > 0, bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), some))

    found = F.when(kind.maybe(text), bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), pieces))
    return F.coalesce(found.cast(SPAN), F.array().cast(SPAN))


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with one struct column of spans by kind, ``into``.email, .ip, .card, .phone, .iban and .ssn.

    Spans are ``(start, end, score)``: code points, end exclusive, score in hundredths
    (what the pattern and checksum give, more with a context word in the 40 code points
    before or after, whatever stands there). Account numbers have the length of their country, so what
    follows one is not part of it. A null text counts as empty and has no spans. Rows are neither dropped nor moved; other columns stay; a column named
    like ``into`` is replaced.
    """
    value = F.coalesce(docs[text].cast("string"), F.lit(""))
    spans = F.struct(*(spans_of(value, kind).alias(kind.name) for kind in KINDS))
    none = F.struct(*(F.array().cast(SPAN).alias(kind.name) for kind in KINDS))
    return docs.withColumn(into, F.when(F.rlike(value, F.lit("[0-9@]")), spans).otherwise(none))


def listed(spans: Column, kinds: tuple[Kind, ...]) -> Column:
    """``kind:start:end`` of all spans, by kind and start, comma-joined."""

    def one(kind: Kind) -> Column:
        return F.transform(
            spans[kind.name], lambda s: F.concat_ws(":", F.lit(kind.name), s["start"].cast("string"), s["end"].cast("string"))
        )

    return F.array_join(F.concat(*(one(kind) for kind in kinds)), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of their spans, all spans and their scores."""
    base = tuple(kind for kind in KINDS if kind.base)
    found = find_pii(docs.select("doc_id", "text"))
    spans = found["pii"]
    return found.select(
        "doc_id",
        *(F.size(spans[kind.name]).cast("long").alias(f"n_{kind.name}") for kind in base),
        F.sha2(listed(spans, base), 256).alias("base_sha256"),
        listed(spans, KINDS).alias("spans"),
        F.array_join(F.concat(*(F.transform(spans[k.name], lambda s: s["score"].cast("string")) for k in KINDS)), ",").alias("scores"),
    )

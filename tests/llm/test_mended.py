"""Context on both sides, account numbers, texts in many scripts, labels that tell nothing, clashing names."""

from __future__ import annotations

import collections
import math
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from climagest.llm import quality
from climagest.llm.bpe import decode, encode
from climagest.llm.licenses import TEMPLATES, scan_licenses
from climagest.llm.pii import CONTEXT, KINDS, pii_digest
from climagest.llm.toxicity import drop_toxic, toxicity_scores


def personal(spark, texts: list[str]) -> list[tuple[str, str]]:
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.spans, r.scores) for r in pii_digest(rows).orderBy("doc_id").collect()]


@pytest.mark.parametrize(
    "text, spans, scores",
    [
        ("my number is 123-45-6789 (SSN)", "ssn:13:24", "60"),
        ("SSN: 123-45-6789, 234-56-7890", "ssn:5:16,ssn:18:29", "60,60"),
        ("+1 555 123 4567 is my phone", "phone:0:15", "80"),
        ("phone " + "1 " * 30 + "+1 555 123 4567", "phone:66:81", "60"),
        ("IBAN DE89 3704 0044 0532 0130 00 EUR 500", "iban:5:32", "100"),
        ("IBAN DE89370400440532013000 GB82WEST12345698765432", "iban:5:27,iban:28:50", "100,100"),
        ("a DE89370400440532013000123 b", "iban:2:24", "80"),
        ("ZZ89370400440532013000", "", ""),
    ],
)
def test_context_and_account_numbers(spark, text, spans, scores):
    assert personal(spark, [text]) == [(spans, scores)]


def test_context_is_what_stands_around_the_span(spark):
    """Scores of the base kinds in texts with many matches, from plain substrings."""
    texts = [
        "1.2.3.4 " * 12 + "host " + "5.6.7.8,9.9.9.9 " * 9 + "é漢😀 " * 9 + "server",
        "mail " + "a@b.c " * 200 + "z" * 41 + " a@b.c contact",
        "x@y.z" + " " * 36 + "mail" + " " * 200 + "x@y.z" + " " * 40 + "mail",
        "call +1 555 123 4567 1.1.1.1 or tel. 4111 1111 1111 1111 pay",
    ]
    kinds = {kind.name: kind for kind in KINDS}
    for text, (spans, scores) in zip(texts, personal(spark, texts)):
        assert spans
        for span, score in zip(spans.split(","), scores.split(",")):
            name, start, end = span.split(":")
            start, end, kind = int(start), int(end), kinds[name]
            near = f"{text[max(0, start - CONTEXT) : start]}\n{text[end : end + CONTEXT]}".lower()
            assert int(score) == kind.score + 20 * bool(re.search(rf"\b(?:{kind.words})\b", near)), (text, span)


# ---- quality: the model worked out anew on tuples of signs


def signs(text: str) -> list:
    found = []
    for c in text:
        point = max(3, ord(c))
        found += [point] if point < 1920 else [("first", (point - 1920) // 1088), ("second", (point - 1920) % 1088)]
    return [1, 1, 1, 1, *found, 2]


def grams_of(text: str) -> list[tuple]:
    coded = signs(text)
    return [tuple(coded[i : i + 5]) for i in range(len(coded) - 4)]


class Plain:
    def __init__(self, texts: list[str]) -> None:
        counts = [collections.Counter(g for t in texts for g in grams_of(t))]
        for _ in range(4):
            counts.insert(0, collections.Counter(g[1:] for g in counts[0]))
        self.levels = []
        for level in counts:
            ones, twos, threes, fours = (sum(n == i for n in level.values()) for i in (1, 2, 3, 4))
            cut = [0.5] * 3
            if ones and twos and threes:
                share = ones / (ones + 2 * twos)
                cut = [1 - 2 * share * twos / ones, 2 - 3 * share * threes / twos, 3 - 4 * share * fours / threes]
                cut = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(cut)]
            total, left = collections.Counter(), collections.defaultdict(float)
            for gram, n in level.items():
                total[gram[:-1]] += n
                left[gram[:-1]] += cut[min(n, 3) - 1]
            self.levels.append((level, cut, total, left))

    def chance(self, gram: tuple) -> float:
        if not gram:
            return 1 / 4096
        level, cut, total, left = self.levels[len(gram) - 1]
        context, below = gram[:-1], self.chance(gram[1:])
        if context not in total:
            return below
        n = level.get(gram, 0)
        return (n - (cut[min(n, 3) - 1] if n else 0)) / total[context] + left[context] / total[context] * below

    def perplexity(self, text: str) -> float:
        return math.exp(-sum(math.log(self.chance(g)) for g in grams_of(text)) / (len(text) + 1))


def test_perplexity_in_many_scripts(spark):
    trusted = ["一切皆流 万物皆变", "一刀两断 万里长城", "ここに本がある", "ภาษาไทย", "привет мир", "“quoted” — text 😀", "banana bandana", "aab"] * 2
    others = ["刀一两断", "一丁丂", "ไทย", "мир", "😀😁", "bananas", "", "\U0010ffff"]
    rows = [(i, t.encode(), i < len(trusted)) for i, t in enumerate([*trusted, *others])]
    frame = spark.createDataFrame(rows, "doc_id long, text binary, trusted boolean")
    logs = quality.log_probabilities(quality.gram_counts(frame))
    found = {r.doc_id: r.perplexity for r in quality.perplexities(frame, logs, ["doc_id"]).collect()}
    model = Plain(trusted)
    for i, text, _ in rows:
        assert math.isclose(found[i], model.perplexity(text.decode()), rel_tol=1e-9), text.decode()


def test_characters_are_not_merged():
    points = [*range(3, 5000), *range(0x4E00, 0x5300), *range(0xAC00, 0xAE00), *range(0x1F600, 0x1F700), 0x10FFFF]
    found = {tuple(quality.codes(chr(p))) for p in points if not 0xD800 <= p < 0xE000}
    assert len(found) == len(set(points))
    assert max(map(max, found)) < 1 << quality.BITS


# ---- toxicity


@pytest.mark.parametrize("marks", [{1: 1, 2: 1, 3: 1}, {1: 0, 2: 0}, {1: 0, 2: 1, 3: 1}])
def test_texts_without_evidence_stay(spark, marks):
    """Labels of one class, or the same text with both labels, say nothing of other texts."""
    texts = {1: "some words here", 2: "some words here", 3: "Some words here", 4: "quite another text", 5: "", 6: None}
    docs = spark.createDataFrame([(i * 7, t) for i, t in texts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i * 7, m) for i, m in marks.items()], "doc_id long, toxic int")
    assert {28, 35, 42} <= {r.doc_id for r in drop_toxic(docs, labels).collect()}
    assert all(0 <= r.score <= 1 for r in toxicity_scores(docs, labels).collect())


# ---- licenses


def test_names_that_clash_or_hold_dots(spark):
    text = f"some words first {TEMPLATES['bsd']} and more"
    docs = spark.createDataFrame([(1, text, "x", "y"), (2, "nothing of the kind in here", "x", "y")], "doc_id long, text string, `Licenses` string, `a.b` string")
    found = scan_licenses(docs)
    assert found.columns == ["doc_id", "text", "a.b", "licenses"]
    assert {r.doc_id: [x.license for x in r.licenses] for r in found.select("doc_id", "licenses").collect()} == {1: ["bsd"], 2: []}
    assert found.where(F.size("licenses") > 0).count() == 1


def test_pipeline_takes_names_with_dots(spark, tmp_path):
    rows = [(i, f"document {i} has words of its own {i * 17} and {i * 31}", "en", f"src{i % 7}", "x", "y") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `a.b` string, `Score` string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    spark.createDataFrame([(1, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "a.b", "Score"]
        assert docs.count() > 0
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode(docs.withColumnRenamed("Score", "TOKENS"), vocabulary, public_tokenizers.PATTERN)
    back = decode(coded, vocabulary).collect()
    assert back and all(bytes(r.decoded).decode() == r.text for r in back)

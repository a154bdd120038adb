"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator on documents."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from climagest.llm.bpe import decode, encode, token_digest
from climagest.llm.exact_dedup import drop_copies, exact_duplicates
from climagest.llm.licenses import scan_licenses
from climagest.llm.mixing import Mixture, mixed, mixture_of
from climagest.llm.near_dedup import keep_one, near_duplicates
from climagest.llm.pii import find_pii, pii_digest
from climagest.llm.quality import quality
from climagest.llm.toxicity import drop_toxic, toxicity_scores

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 1), (None, 1, 1), (99, 0, None)], "doc_id long, quality int, toxic int")


def test_pii(edges, nothing):
    assert pii_digest(edges).count() == edges.count()
    assert set(find_pii(edges).columns) == set(edges.columns)
    assert pii_digest(nothing).count() == 0


def test_near_duplicates(edges, nothing):
    rows = sorted(near_duplicates(edges).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_shingles))
    assert [(r.doc_id, r.component_id, r.kept) for r in rows] == [
        (1, 1, True),
        (2, 1, False),
        (2, 1, False),
        (3, 1, False),
        (4, 4, True),
        (5, 5, True),
        (6, 6, True),
        (7, 7, True),
        (8, 8, True),
        (9, 9, True),
        (10, 10, True),
        (None, None, True),
        (None, None, True),
    ]
    assert [r.n_shingles for r in rows if r.doc_id in (4, 5, 6, 7)] == [0, 0, 0, 1]
    kept = keep_one(edges)
    assert kept.columns == edges.columns
    assert kept.count() == 10
    assert near_duplicates(nothing).count() == keep_one(nothing).count() == 0


def test_exact_duplicates(edges, nothing):
    rows = exact_duplicates(edges).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size) for r in rows if r.doc_id in (1, 2, 3)) == [
        (1, 3, 4),
        (2, 3, 4),
        (2, 3, 4),
        (3, 3, 4),
    ]
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in rows if r.group_size == 3) == [
        (0, 5, 3, False),
        (4, 5, 3, False),
        (5, 5, 3, True),
    ]
    kept = drop_copies(edges)
    assert kept.columns == edges.columns
    assert kept.count() == 8
    assert drop_copies(nothing).count() == exact_duplicates(nothing).count() == 0


def test_clashing_digests_are_told_apart_by_bytes(edges):
    """With a digest that is the same for all texts of a length, results do not change."""
    weak = lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 2), 4, "0"))
    key = lambda df: sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in df.collect())
    assert key(exact_duplicates(edges, weak)) == key(exact_duplicates(edges))


def test_state_grows_over_micro_batches(spark, edges):
    """One file per micro-batch gives what a single batch gives."""
    many = edges.repartition(6)
    key = lambda df: sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in df.collect())
    assert key(exact_duplicates(many, batch_bytes=1)) == key(exact_duplicates(edges))


def test_bpe(edges, nothing):
    assert token_digest(edges, VOCABULARY, public_tokenizers.PATTERN).count() == edges.count()
    back = decode(encode(edges, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.select("text", "decoded").collect())
    assert encode(nothing, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_licenses(edges, nothing):
    assert scan_licenses(edges).where(F.size("licenses") > 0).count() == 0
    assert scan_licenses(edges).count() == edges.count()
    assert scan_licenses(nothing).count() == 0


def test_toxicity(edges, nothing, labels):
    rows = toxicity_scores(edges, labels).collect()
    assert len(rows) == edges.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert drop_toxic(edges, labels.where("false")).columns == edges.columns
    assert drop_toxic(edges, labels.where("false")).count() == edges.count()
    assert toxicity_scores(nothing, labels).count() == 0


def test_quality(edges, nothing, labels):
    rows = quality(edges, labels).collect()
    assert len(rows) == edges.count()
    assert all(r.perplexity > 0 for r in rows)
    assert quality(edges, labels.where("false")).where("not kept").count() == 0
    assert quality(nothing, labels).count() == 0


def test_mixing(edges, nothing):
    rows = mixture_of(edges, Mixture(epochs=2)).collect()
    assert len(rows) == edges.count()
    assert all(r.copies == 0 for r in rows if r.n_tokens == 0)
    assert mixed(edges).columns == edges.columns
    assert mixture_of(nothing).count() == mixed(nothing).count() == 0


def test_stages_keep_the_columns(spark, edges, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    edges.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == edges.columns
    digests = {hashlib.sha256(str(r).encode()).hexdigest() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(digests) > 3

"""Whole texts reach Python once and in small batches in the stages of the pipeline."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from climagest.llm.bpe import HELD, Encoder, decode, encode
from climagest.llm.columns import with_mapped
from climagest.sources import shared

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def counting():
    """Local, so that it is sent to the workers whole."""

    def start():
        return lambda texts: pa.array([None if x.as_py() is None else len(x.as_py()) for x in texts], pa.int64())

    return start


def test_a_kept_text_is_sent_once(spark):
    rows = [(1, "é ñ", "en"), (2, None, None), (3, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, `a.text` string, lang string")
    found = with_mapped(docs, "a.text", "n", T.LongType(), counting())
    assert sorted(map(tuple, found.collect())) == [(1, "é ñ", "en", 5), (2, None, None, None), (3, "", "x", 0)]
    assert "as binary" not in found._jdf.queryExecution().analyzed().toString()
    left = with_mapped(docs, "a.text", "n", T.LongType(), counting(), ["lang"])
    assert left.columns == ["lang", "n"] and {r.n for r in left.collect()} == {5, None, 0}
    replaced = with_mapped(docs, "a.text", "A.TEXT", T.LongType(), counting())
    assert replaced.columns == ["doc_id", "lang", "A.TEXT"] and {r[2] for r in replaced.collect()} == {5, None, 0}


def test_texts_that_are_not_strings_or_not_utf8(spark):
    numbers = with_mapped(spark.range(3).withColumnRenamed("id", "text"), "text", "n", T.LongType(), counting())
    assert sorted(map(tuple, numbers.collect())) == [(0, 1), (1, 1), (2, 1)]
    broken = spark.createDataFrame([(1, bytearray(b"a\xffb"))], "doc_id long, raw binary")
    broken = broken.select("doc_id", F.col("raw").cast("string").alias("text"))
    found = with_mapped(broken, "text", "n", T.LongType(), counting()).select("n", F.octet_length("text").alias("m"))
    assert tuple(found.first()) == (3, 3)


def test_stages_hand_texts_over_in_small_batches(spark, tmp_path, monkeypatch):
    rows = [(i, f"document {i} has words of its own {i * 17} and {i * 31}", "en", f"src{i % 7}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    before, seen = spark.conf.get(BATCH), {}

    def noted(df, label="table"):
        seen[label] = int(spark.conf.get(BATCH))
        return shared.written(df, label)

    monkeypatch.setattr(corpus_pipeline, "written", noted)
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert list(seen) == ["toxicity", "exact-dedup", "near-dedup", "mixing", "encoding"]
    assert seen["toxicity"] <= 256 and seen["encoding"] <= 256
    assert spark.conf.get(BATCH) == before
    texts = {row[0]: row[1] for row in rows}
    back = decode(done, VOCABULARY).collect()
    assert back and all(bytes(r.decoded).decode() == texts[r.doc_id] and r.n_tokens == len(r.tokens) for r in back)


def test_pieces_remembered_do_not_change_tokens(spark):
    text = " ".join(f"word{i * 7919 % 1000} é{i % 50}" for i in range(3000))
    lines = open(VOCABULARY, "rb").read()
    small, large = (Encoder(lines, public_tokenizers.PATTERN, most) for most in (1 << 12, HELD))
    assert (small.encode(text) == large.encode(text)).all()
    assert small.held <= 1 << 12 and small.before
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    coded = encode(docs, VOCABULARY, public_tokenizers.PATTERN, keep=["doc_id"], most=1 << 12)
    assert coded.columns == ["doc_id", "tokens"]
    assert coded.first().tokens == large.encode(text).tolist()

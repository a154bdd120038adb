"""Stages that turn documents into training data.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. Its result is written
as Parquet once and read again as the next one's documents; then the tables before it are deleted. Stages that hand
whole texts to Python do so in batches of few rows, so neither the JVM nor a worker holds a task's texts at once;
the number of rows is a setting at the time of writing, so they write their result themselves. The others hand on
a plan, which is written by whoever goes on from it: written here, too, it would lie on disk twice.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climagest.llm.bpe import encode
from climagest.llm.exact_dedup import drop_copies, settings
from climagest.llm.mixing import mixed
from climagest.llm.near_dedup import BATCHES, keep_one
from climagest.llm.toxicity import drop_toxic
from climagest.sources.shared import delete, noted, written

#: Bytes of pieces that a worker remembers in each of two generations: less than where encoding runs alone.
PIECES = 16 << 20


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones, rejects go."""
    kept = drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    with settings(spark, BATCHES):
        return written(kept, "toxicity")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of its domain, language and source ask for."""
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left; repeated rows of the mixture stay repeated."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows, names = docs.select("doc_id", "lang", "source", "text"), ["doc_id", "lang", "source"]
    coded = encode(rows, vocabulary, public_tokenizers.PATTERN, keep=names, most=PIECES)
    coded = coded.select(*names, F.size("tokens").cast("long").alias("n_tokens"), "tokens")
    with settings(spark, BATCHES):
        return written(coded, "encoding")


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("byte-level BPE", encoding),
]
#: Stages that hand on a plan, and the names of their tables.
PLANS = {exact_dedup: "exact-dedup", near_dedup: "near-dedup", mixing: "mixing"}
#: The classifier and the encoding have no SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of a folder.

    When a stage's result is written, its input and what it wrote on the way are deleted, so at most two
    stages' results lie on disk.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for _, stage in STAGES:
        with noted(spark) as made:
            docs = stage(spark, docs, sf_dir)
            if stage in PLANS:
                docs = written(docs, PLANS[stage])
        *on_the_way, result = made  # a result is written last
        delete(spark, before + on_the_way)
        before = [result]
    return docs

"""The operators applied to their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from climagest.llm.alignment import token_alignment
from climagest.llm.ann import embedding_neighbours
from climagest.llm.bpe import token_digest
from climagest.llm.chat import chat_digest
from climagest.llm.exact_dedup import copy_digest
from climagest.llm.licenses import license_report
from climagest.llm.line_rules import line_report
from climagest.llm.mixing import mixture_of
from climagest.llm.near_dedup import near_duplicates
from climagest.llm.phrases import collocations
from climagest.llm.pii import pii_digest
from climagest.llm.quality import quality
from climagest.llm.toxicity import toxicity_scores

#: A conversation whose texts hold what the template marks turns with.
MARKS = r"\### Assistant: </turn> ok"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii_digest(table(spark, folder, "documents"))


def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return copy_digest(table(spark, folder, "documents"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixture_of(table(spark, folder, "documents"))


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_report(table(spark, folder, "documents"))


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_digest(table(spark, folder, "documents"), vocabulary, public_tokenizers.PATTERN)


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    marked = [(-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS)]
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digest(turns.union(spark.createDataFrame(marked, turns.schema)))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_neighbours(table(spark, folder, "embeddings"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    first, second = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment(table(spark, folder, "documents"), first, second)


def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


def op13_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_report(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_near_dedup,
        op3_exact_dedup,
        op4_quality,
        op5_mixing,
        op6_licenses,
        op7_bpe,
        op8_chat,
        op9_toxicity,
        op10_neighbours,
        op11_alignment,
        op12_phrases,
        op13_line_rules,
    )
}

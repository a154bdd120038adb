"""Exact duplicates with streaming state that never expires.

Digests of the texts are laid down as arrivals and streamed into a keyed state on disk
(RocksDB). Per digest the state holds how many rows came, the identifier of the row that
stays and where its content lies (file and row in it). Aggregation before the shuffle
means that a digest borne by a third of all rows reaches its state as one row per task.
Every text whose digest came more than once is compared byte by byte; digests that stand
for different texts are told apart by the texts themselves.
"""

from __future__ import annotations

import contextlib
import string
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from climagest.llm.toxicity import free_name
from climagest.sources.shared import fresh_path, settled, small, written

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # no megabytes set aside beforehand for the log of each partition
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Bytes of arrivals (some 50 per document) taken in one micro-batch.
BATCH_BYTES = 16 << 30
FILE, ROW = "content file", "content row"


def normal_text(text: Column) -> Column:
    """A-Z lower-cased; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def located(docs: DataFrame, file: str = FILE, row: str = ROW) -> DataFrame:
    """``docs`` with the file and the row in it that each row comes from; stored first unless read from Parquet as it is."""
    places = [F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)]
    try:
        return docs.select("*", *places)
    except AnalysisException:
        return written(docs, "content").select("*", *places)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def keyed_state(spark: SparkSession, arrivals: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``digest, keep, n`` after all files in the folder ``arrivals`` have been streamed into the state."""
    checkpoint = fresh_path(spark, "state")
    with settings(spark, STATE):
        stream = spark.readStream.schema(spark.read.parquet(arrivals).schema).option("maxBytesPerTrigger", batch_bytes)
        groups = (
            stream.parquet(arrivals)
            .groupBy("digest")
            .agg(F.max(F.struct("doc_id", FILE, ROW)).alias("keep"), F.count(F.lit(1)).alias("n"))
        )
        query = (
            groups.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
    value = state.schema["value"].dataType.names
    keep, n = (F.col(f"value.`{name}`") for name in value)
    return state.select(F.col("key.digest").alias("digest"), keep.alias("keep"), n.alias("n"))


def exact_duplicates(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, digest, keep_id, group_size, kept`` and its place.

    Texts are equal when the same after lower-casing A-Z; null counts as empty. Of equal
    texts the row with the largest ``doc_id`` stays; null is below every id; of rows that
    share it the last in file order stays, so exactly one row of a group is kept.
    """
    spark = docs.sparkSession
    rows = located(docs.select("doc_id", "text"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), FILE, ROW, normal_text(F.col("text")).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    arrivals = fresh_path(spark, "arrivals")
    rows.drop("text").write.parquet(arrivals)
    groups = written(keyed_state(spark, arrivals, batch_bytes), "groups")

    repeated = small(groups.where("n > 1"))
    texts = rows.join(repeated, "digest", "left_semi")
    spans = texts.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    clashes = written(spans.where("low <> high").select("digest"), "clashes")

    placed = spark.read.parquet(arrivals)
    # a digest that came once stands for the row itself
    alone = F.struct("doc_id", FILE, ROW)
    found = placed.join(repeated, "digest", "left")
    found = found.withColumns({"keep": F.coalesce("keep", alone), "n": F.coalesce("n", F.lit(1))})
    if not clashes.isEmpty():
        apart = rows.join(small(clashes), "digest", "left_semi")
        exact = apart.groupBy("digest", "text").agg(
            F.max(F.struct("doc_id", FILE, ROW)).alias("keep"), F.count(F.lit(1)).alias("n")
        )
        found = found.join(small(clashes), "digest", "left_anti").unionByName(
            apart.join(written(exact, "groups"), ["digest", "text"]).drop("text")
        )
    return found.select(
        "doc_id",
        "digest",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col(FILE) == F.col(f"keep.`{FILE}`")) & (F.col(ROW) == F.col(f"keep.`{ROW}`"))).alias("kept"),
        FILE,
        ROW,
    )


def drop_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns; rows with null or empty texts are one group."""
    file, row = free_name(docs, FILE), free_name(docs, ROW)
    here = located(docs, file, row)

    def places() -> DataFrame:
        copies = exact_duplicates(here.drop(file, row), digest).where("not kept")
        return copies.select(F.col(FILE).alias(file), F.col(ROW).alias(row))

    left = here.join(small(settled(docs.sparkSession, places, "gone")), [file, row], "left_anti")
    return left.select(*(f"`{name}`" for name in docs.columns))


def copy_digest(docs: DataFrame) -> DataFrame:
    """Per document: the row that stays, the size of its group and the digest of its normal text."""
    found = exact_duplicates(docs)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))

"""Datasets by postcode of which single postcodes can be replaced.

Every run writes its postcodes into a directory of its own, and then a manifest that says which directory holds
which postcode. Readers go by the last manifest alone: a run that fails has written none, so the old rows stay, and a
run that succeeds is seen whole or not at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climagest.sources.readers import ZIP_PART
from climagest.sources.shared import small, written
from climagest.sources.writers import write_by_location

MANIFEST = f"{ZIP_PART} int, version string, generation long"


def _generations(spark: SparkSession, root: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Which version holds each postcode now."""
    every = _generations(spark, root)
    last = every.agg(F.max("generation")).first()[0]
    return every.where(F.col("generation") == F.lit(last)).select(ZIP_PART, "version")


def publish(df: DataFrame, root: str, locations: Iterable[int] | None = None, location: str = "location") -> None:
    """Write ``df`` and let it stand for ``locations``: for all postcodes by default, replacing the dataset.

    Rows of other postcodes are left out, and a named postcode without rows is emptied. One writer at a time.
    """
    spark, version = df.sparkSession, f"v{uuid.uuid4().hex}"
    named = None if locations is None else spark.createDataFrame([(z,) for z in locations], f"{ZIP_PART} int").distinct()
    rows = df if named is None else df.join(F.broadcast(named.withColumnRenamed(ZIP_PART, location)), location, "left_semi")
    path = f"{root}/data/version={version}"
    write_by_location(rows, path, location)
    held = written(rows.sparkSession.read.schema(f"{ZIP_PART} int").parquet(path).select(ZIP_PART).distinct(), "locations")
    entries = held.select(ZIP_PART, F.lit(version).alias("version"))
    if named is not None:
        entries = entries.unionByName(manifest(spark, root).join(F.broadcast(named), ZIP_PART, "left_anti"))
    number = (_generations(spark, root).agg(F.max("generation")).first()[0] or 0) + 1
    # one file, so that it is there whole or not at all
    entries.coalesce(1).write.parquet(f"{root}/manifest/generation={number}")


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The rows that stand now, with ``zip_part``. Directories that the manifest does not name are not opened."""
    now = written(manifest(spark, root), "manifest")
    data = spark.read.parquet(f"{root}/data")
    return data.join(small(now), ["version", ZIP_PART], "left_semi").drop("version")

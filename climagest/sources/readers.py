"""Parquet and CSV inputs."""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climagest.functions.dates import text_date
from climagest.functions.numbers import to_number, to_whole
from climagest.schema import WEATHER
from climagest.sources.shared import written

ZIP_PART = "zip_part"
#: Where a row lies: its file, and the row in it. Files count in the order of their names.
PLACE = ("_file", "_row")


def with_place(df: DataFrame) -> DataFrame:
    """``df``, as it is read from Parquet, with the columns ``PLACE``."""
    try:
        return df.select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))
    except AnalysisException as unknown:
        raise ValueError("only rows read straight from Parquet have a place; store the table first") from unknown


def read_births(
    spark: SparkSession, path: str, format: str = "parquet", id_type: str | None = None, place: bool = False
) -> DataFrame:
    """Births with the columns RFA_ID, ZIP, ADMD and GEST as they are stored.

    CSV gives text; ``id_type`` ("long") casts the record id, so that births are numbered as from Parquet.
    An id that does not fit is an error. ``place`` adds ``PLACE``.
    """
    table = _read(spark, path, format)
    table, more = (with_place(table), PLACE) if place else (table, ())
    record = F.col("RFA_ID").cast(id_type) if id_type else F.col("RFA_ID")
    return table.select(record.alias("RFA_ID"), "ZIP", "ADMD", "GEST", *more)


def read_weather(
    spark: SparkSession,
    path: str,
    family: str = "Hot",
    format: str = "parquet",
    exposure_col: str | None = None,
    place: bool = False,
) -> DataFrame:
    """Daily weather with the flags of ``family`` ("Hot" or "Cold") and any further column wanted as exposure.

    Columns the file lacks are left out: the cold file carries no temperature. Text that holds no number is
    missing; text that holds no date is an error. ``place`` adds ``PLACE``.
    """
    table = _read(spark, path, format)
    table, more = (with_place(table), PLACE) if place else (table, ())
    stored = {field.name.lower(): field.dataType for field in table.schema}
    fields = [f for f in WEATHER[family].fields if f.name.lower() in stored]
    if exposure_col and exposure_col.lower() not in {f.name.lower() for f in fields}:
        fields.append(T.StructField(exposure_col, T.DoubleType()))

    def read(field: T.StructField) -> Column:
        if isinstance(stored[field.name.lower()], T.StringType):
            return _parsed(field)
        if field.name == "Zip":
            return F.col(field.name)  # as stored, so that a postcode bound reaches the file
        return F.col(field.name).try_cast(field.dataType)

    return table.select(*(read(f).alias(f.name) for f in fields), *more)


def read_location(spark: SparkSession, root: str, location: int) -> DataFrame:
    """One postcode of a partitioned dataset; other directories are not opened."""
    return spark.read.parquet(root).where(F.col(ZIP_PART) == location)


def list_locations(spark: SparkSession, root: str) -> DataFrame:
    """The postcodes a partitioned dataset holds."""
    return spark.read.parquet(root).select(ZIP_PART).distinct()


DELIMITERS = (",", ";", "\t", "|")


def read_checked_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV file or folder as text columns, and the lines that are no rows: ``file`` and ``text``.

    A line is no row if it has not as many fields as the header or its quotes do not end. The delimiter, unless given, is the
    one most frequent in the header. All files begin with the same header. Lines are parsed once.
    """
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError(f"{path} is empty")
    line = header[0].lstrip("\ufeff")
    delimiter = delimiter or max(DELIMITERS, key=line.count)
    names = [name.strip() for name in next(csv.reader([line], delimiter=delimiter))]
    bad, file = "_bad_line", "_bad_file"
    schema = T.StructType([T.StructField(name, T.StringType()) for name in (*names, bad)])
    rows = spark.read.csv(
        path, sep=delimiter, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord=bad, ignoreLeadingWhiteSpace=True
    )
    # stored with all columns: only then are all fields of a line counted
    stored = written(rows.withColumn(file, F.col("_metadata.file_path")), "csv")
    wrong = stored.where(F.col(bad).isNotNull()).select(F.col(file).alias("file"), F.col(bad).alias("text"))
    return stored.where(F.col(bad).isNull()).drop(bad, file), wrong


def _read(spark: SparkSession, path: str, format: str) -> DataFrame:
    if format == "csv":
        # Columns are found by header name and parsed below, so no pass over the
        # file is spent on type inference and column order does not matter.
        return spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True)
    return spark.read.format(format).load(path)


def _parsed(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.DateType):
        return text_date(field.name)
    if isinstance(field.dataType, T.IntegerType):
        return to_whole(field.name)
    return to_number(field.name)

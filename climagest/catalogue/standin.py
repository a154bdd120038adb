"""Births and weather derived from the order tables, for testing.

Orders play births and shipped quantities play temperatures. The flag formulas
are stand-ins: real weather comes with its flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from climagest.schema import DAY_ZERO

FLAG_SHARES = (0.90, 0.95, 0.97, 0.99, 0.10, 0.05, 0.03, 0.01)


HOT = 29401  # has over a third of all births


def postcode(key: str) -> Column:
    """One of 320 postcodes three apart, the last five of them beyond the bounds, or the hot one."""
    usual = 29001 + (F.col(key) * 37) % 320 * 3
    return F.when(F.col(key) % 20 < 7, HOT).otherwise(usual).cast("int")


def weather_postcode(key: str) -> Column:
    """The same, but that every sixteenth postcode has no weather; its rows are the hot one's."""
    return F.when((F.col(key) * 37) % 320 % 16 == 5, HOT).otherwise(postcode(key)).cast("int")


def births(spark: SparkSession, folder: str) -> DataFrame:
    """RFA_ID, ZIP, ADMD (days since 1960) and GEST (weeks)."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return orders.select(
        F.col("o_orderkey").alias("RFA_ID"),
        postcode("o_custkey").alias("ZIP"),
        F.date_diff(F.col("o_orderdate").cast("date"), F.lit(DAY_ZERO).cast("date")).alias("ADMD"),
        (10 + F.col("o_orderkey") % 38).cast("int").alias("GEST"),
    )


def text_births(spark: SparkSession, folder: str) -> DataFrame:
    """The same births with ZIP and GEST as text, some of it malformed or missing."""
    key, zip_text, gest_text = F.col("RFA_ID"), F.col("ZIP").cast("string"), F.col("GEST").cast("string")
    return births(spark, folder).select(
        "RFA_ID",
        F.when(key % 11 == 0, F.concat(zip_text, F.lit("x")))
        .when(key % 13 != 0, zip_text)
        .alias("ZIP"),
        "ADMD",
        F.when(key % 17 == 0, "unknown").when(key % 19 == 0, F.concat(gest_text, F.lit(".5"))).otherwise(gest_text).alias(
            "GEST"
        ),
    )


def two_zip_births(spark: SparkSession, folder: str) -> DataFrame:
    """Births with a second postcode column."""
    other = (28801 + F.col("RFA_ID") % 9 * 200).cast("int")
    return births(spark, folder).withColumn("HOSPITAL_ZIP", other)


def temperature(spark: SparkSession, folder: str) -> DataFrame:
    """Zip, Date and TAVG, one row per postcode and day."""
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    day = F.col("l_shipdate").cast("date").alias("Date")
    return lineitem.groupBy(weather_postcode("l_partkey").alias("Zip"), day).agg(F.avg("l_quantity").alias("TAVG"))


def weather(spark: SparkSession, folder: str, family: str = "Hot") -> DataFrame:
    """Temperature and the ten flags of ``family``."""
    days = temperature(spark, folder)
    shares = F.array(*(F.lit(s) for s in FLAG_SHARES))
    cuts = days.groupBy("Zip").agg(F.percentile("TAVG", shares).alias("cuts"))
    names = ("p90", "p95", "p97", "p99", "p10", "p05", "p03", "p01")
    cuts = cuts.select("Zip", *(F.col("cuts")[i].alias(n) for i, n in enumerate(names)))
    flagged = days.join(cuts, "Zip")
    return flagged.select("Zip", "Date", "TAVG", *(F.expr(f"int({rule})").alias(f) for f, rule in FORMULAS[family].items()))


FORMULAS = {
    "Hot": {
        "No_Heatwave": "TAVG <= p90",
        "Heatwave_days": "TAVG > p90",
        "Severe_Heatwaves": "TAVG > p95",
        "Extreme_Heatwaves": "TAVG > p99",
        "Above_95th": "TAVG > p95",
        "Above_97th": "TAVG > p97",
        "Above_99th": "TAVG > p99",
        "low_intensity": "TAVG > p90 AND TAVG <= p95",
        "moderate_intensity": "TAVG > p95 AND TAVG <= p97",
        "high_intensity": "TAVG > p97",
    },
    "Cold": {
        "No_Coldwave": "TAVG >= p10",
        "Coldwave_days": "TAVG < p10",
        "Severe_Coldwaves": "TAVG < p05",
        "Extreme_Coldwaves": "TAVG < p01",
        "Below_5th": "TAVG < p05",
        "Below_3rd": "TAVG < p03",
        "Below_1st": "TAVG < p01",
        "low_intensity": "TAVG < p10 AND TAVG >= p05",
        "moderate_intensity": "TAVG < p05 AND TAVG >= p03",
        "high_intensity": "TAVG < p03",
    },
}

"""What cleaning drops, counted while it drops it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "table string, reason string, n long"


class Ledger:
    """Counts of rows by table and reason, observed on rows as they pass; no pass is made for them.

    A table's counts are complete once an action has run over it, and are those of its first action.
    """

    def __init__(self) -> None:
        self._observed: dict[str, Observation] = {}

    def watch(self, df: DataFrame, table: str, reasons: dict[str, Column]) -> DataFrame:
        """``df``, counting its rows and those for which a reason holds. Filters do not pass this point downwards."""
        if table in self._observed:
            raise ValueError(f"{table} is being watched already")
        self._observed[table] = Observation(table)
        counts = [F.count_if(F.coalesce(holds, F.lit(False))).alias(reason) for reason, holds in reasons.items()]
        return df.observe(self._observed[table], F.count(F.lit(1)).alias("rows"), *counts)

    def entries(self) -> list[tuple[str, str, int]]:
        """Table, reason and number. Waits for the action over a watched table."""
        return [(table, reason, n) for table, seen in self._observed.items() for reason, n in seen.get.items()]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.entries(), SCHEMA)

    def write(self, spark: SparkSession, path: str) -> str:
        self.table(spark).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        return path

"""Storage every executor can reach, and size-checked broadcasts."""

from __future__ import annotations

import contextlib
import contextvars
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SMALL_ROWS = 1_000_000
#: Values that one task makes of narrow rows.
TASK_VALUES = 1 << 22
#: As many times more where rows are laid out in order and there are tasks enough for every core: each task costs the driver
#: a sample of the order, and a file with a dictionary for every column.
LAID_TASKS = 2


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    What the cluster names there is taken to be shared, whatever its scheme (a mounted file system has
    ``file:``). Only a local session may fall back to a temporary folder; on a cluster a
    machine-local folder is not visible to the other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="climagest-"))
    return context.getCheckpointDir()


_OWNED: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("owned", default=None)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if (owned := _OWNED.get()) is not None:
        owned.append(path)
    return path


@contextlib.contextmanager
def noted(spark: SparkSession) -> Iterator[list[str]]:
    """The paths that ``fresh_path`` gives inside, in that order; an outer ``noted`` or ``scratch`` gets them at the end."""
    owned: list[str] = []
    token = _OWNED.set(owned)
    try:
        yield owned
    finally:
        _OWNED.reset(token)
        if (outer := _OWNED.get()) is not None:
            outer.extend(owned)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables written to paths of ``fresh_path``; those that are gone already are passed over."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the intermediate tables written inside.

    Results read from them have to be written elsewhere inside, too, since DataFrames are lazy.
    """
    with noted(spark) as owned:
        try:
            yield
        finally:
            delete(spark, owned)


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes a broadcast may have: ``spark.climagest.broadcastBytes``, else a sixteenth of the driver's memory, 512 MB at most."""
    named = spark.conf.get("spark.climagest.broadcastBytes", None)
    if named:
        return int(named)
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", spark.conf.get("spark.driver.memory", "1g").lower()).groups()
    return min(512 << 20, (int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit, 20)) // 16)


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to shared storage and go on from the files.

    Cuts the lineage so that a lost executor costs a re-read instead of a
    recomputation, and keeps column pruning for the readers.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str = "table") -> DataFrame:
    """What ``make`` gives, written like ``written``; the tables that it wrote on the way are deleted.

    For results much smaller than what they are made from.
    """
    path = fresh_path(spark, label)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` holds no more than ``rows`` rows. Counts are combined in each task first."""
    return df.count() <= rows


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its row count is checked to be small.

    Beyond ``rows`` it is handed back unmarked and Spark joins by shuffle.
    """
    return F.broadcast(df) if has_at_most(df, rows) else df


def tasks_for(df: DataFrame, values: int) -> int:
    """Tasks over which ``df`` has to be dealt if each row becomes ``values`` values; the rows are counted."""
    return max(1, math.ceil(df.count() * values / TASK_VALUES))


def spread(df: DataFrame, values: int, order: Sequence[str] = (), whole: bool = False) -> DataFrame:
    """``df`` dealt evenly over ``tasks_for`` tasks.

    Narrow rows lie in few, small files, so a step that makes hundreds of values of each would run in few tasks.
    With ``order`` rows are divided among tasks and sorted by these columns, so that rows which become equal values lie
    together and what is written of them stays small. Rows equal in them are told apart by their place in the input, so many copies
    are cut over several tasks, too; with ``whole`` they stay in one task, and grouping by these columns and more needs no further shuffle.
    """
    tasks = tasks_for(df, values)
    if not order:
        return df.repartition(tasks) if tasks > 1 else df
    tasks = max(math.ceil(tasks / LAID_TASKS), min(tasks, 3 * df.sparkSession.sparkContext.defaultParallelism))
    if whole:
        laid = df.repartitionByRange(tasks, *order)
    else:
        laid = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(tasks, *order, "_tie").drop("_tie")
    # always true; Spark drops a sort below a join unless something between them depends on the order
    return laid.sortWithinPartitions(*order).where(F.monotonically_increasing_id() >= 0)

"""A column made by Arrow code beside columns of any name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_mapped(
    docs: DataFrame,
    value: Column | str,
    into: str,
    kind: T.DataType,
    start: Callable[[], Callable[[pa.Array], pa.Array]],
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (all, if not given) with ``into``, of type ``kind``: what the function that ``start`` makes in each task gives for ``value``.

    ``value`` may be the name of a text column: the function gets its bytes, and a column that is kept is not sent twice.
    A column named like ``into``, in whatever case, is replaced. Names may hold dots: Arrow code sees places only.
    """
    others = [name for name in (docs.columns if keep is None else keep) if name.lower() != into.lower()]
    places = [f"c{i}" for i in range(len(others))]
    kept = [F.col(quoted(name)).alias(place) for name, place in zip(others, places)]
    at = len(others)
    if isinstance(value, str):
        if value in others and docs.schema[value].dataType == T.StringType():
            at = others.index(value)
        value = F.col(quoted(value)).cast("string").cast("binary")
    read = docs.select(*kept, value.alias("value")) if at == len(others) else docs.select(*kept)
    schema = T.StructType([*read.schema.fields[: len(others)], T.StructField("found", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = start()
        for batch in batches:
            given = batch.column(at)
            if pa.types.is_string(given.type):
                given = given.cast(pa.binary())
            elif pa.types.is_large_string(given.type):
                given = given.cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(places)], found(given)], names=[*places, "found"])

    return read.mapInArrow(run, schema).toDF(*others, into)

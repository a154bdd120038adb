"""Small literal inputs."""

from __future__ import annotations

import datetime as dt

from climagest.schema import BIRTHS, WEATHER

EPOCH = dt.date(1960, 1, 1)
DELIVERY = dt.date(2001, 6, 15)


def day_number(date: dt.date) -> int:
    return (date - EPOCH).days


def births(spark, *rows):
    """Rows of (RFA_ID, ZIP, delivery date, GEST); text in ZIP or GEST makes the column text."""
    text = any(isinstance(v, str) for row in rows for v in (row[1], row[3]))
    schema = "RFA_ID long, ZIP string, ADMD int, GEST string" if text else BIRTHS
    convert = (lambda v: None if v is None else str(v)) if text else (lambda v: v)
    return spark.createDataFrame(
        [(i, convert(z), None if d is None else day_number(d), convert(g)) for i, z, d, g in rows], schema
    )


def weather(spark, rows, family="Hot"):
    """Rows of (Zip, Date, TAVG, {flag: value})."""
    schema = WEATHER[family]
    flags = schema.fieldNames()[3:]
    return spark.createDataFrame([(z, d, t, *(f.get(name, 0) for name in flags)) for z, d, t, f in rows], schema)


def days_from(first: dt.date, count: int) -> list[dt.date]:
    return [first + dt.timedelta(days=k) for k in range(count)]

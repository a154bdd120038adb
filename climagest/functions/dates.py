"""Date arithmetic of the pregnancy calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climagest.functions.numbers import number_column
from climagest.schema import DAY_ZERO, DAYS_PER_WEEK, WINDOW_DAYS


def day_number_to_date(number: Column, origin: str = DAY_ZERO) -> Column:
    """Date lying ``number`` days after ``origin``."""
    return F.date_add(F.lit(origin).cast("date"), F.floor(number).cast("int"))


def admission_date(births: DataFrame, column: str = "ADMD") -> Column:
    """Delivery date from a day number or a date, stored as such or as text.

    Text that is neither a number nor a date is an error; empty text and ``NA`` are missing.
    """
    stored = births.schema[column].dataType
    if isinstance(stored, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(column).cast("date")
    from_number = day_number_to_date(number_column(births, column))
    if not isinstance(stored, T.StringType):
        return from_number
    return F.coalesce(from_number, text_date(column))


def text_date(column: str) -> Column:
    """Date held by a text; one that holds something else is an error, not a missing date."""
    text = F.trim(column)
    wrong = F.concat(F.lit(f"{column} is not a date: "), text)
    empty = text.isNull() | text.isin("", "NA")
    return F.when(~empty, F.coalesce(text.try_cast("date"), F.raise_error(wrong).cast("date")))


def gestation_days(weeks: Column) -> Column:
    """Days of gestation. Part weeks round up, so that dates counted back round down."""
    return F.ceil(weeks * DAYS_PER_WEEK).cast("int")


def before_delivery(admd: Column, days: Column, windows: int) -> Column:
    """Day lying ``windows`` 13-week windows after the start of gestation."""
    return F.date_sub(admd, days - F.lit(WINDOW_DAYS * windows))


def inclusive_days(start: Column, end: Column) -> Column:
    """Number of days in the closed interval."""
    return F.date_diff(end, start) + 1


def day_sequence(start: Column, end: Column) -> Column:
    """Every day of the closed interval, or null where it is empty.

    ``sequence`` counts backwards when start > end, hence the guard.
    """
    return F.when(start <= end, F.sequence(start, end, F.expr("interval 1 day")))

"""Schemas, flag lists and the five pregnancy windows, stated as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. They define the results and must not drift.
# ---------------------------------------------------------------------------
DAY_ZERO = "1960-01-01"  # ADMD counts days from here
POSTCODE_BOUNDS = (29000, 29945)  # open interval
DAYS_PER_WEEK = 7
WINDOW_DAYS = 91  # 13 weeks: preconception and each full trimester
MAX_SPAN_DAYS = 392  # 301 days of pregnancy + 91 days before it
PERCENTILES = {
    "percentile_95": 0.95,
    "percentile_90": 0.90,
    "percentile_10": 0.10,
    "percentile_05": 0.05,
}

# weather flag column -> name of the count
HEAT_FLAGS = {
    "No_Heatwave": "No_Heatwave",
    "Heatwave_days": "Heatwave",
    "Severe_Heatwaves": "Severe_Heatwave",
    "Extreme_Heatwaves": "Extreme_Heatwave",
    "Above_95th": "Above_95th",
    "Above_97th": "Above_97th",
    "Above_99th": "Above_99th",
    "low_intensity": "low_intensity",
    "moderate_intensity": "moderate_intensity",
    "high_intensity": "high_intensity",
}
COLD_FLAGS = {
    "No_Coldwave": "No_Coldwave",
    "Coldwave_days": "Coldwave",
    "Severe_Coldwaves": "Severe_Coldwave",
    "Extreme_Coldwaves": "Extreme_Coldwave",
    "Below_5th": "Below_5th",
    "Below_3rd": "Below_3rd",
    "Below_1st": "Below_1st",
    "low_intensity": "low_intensity",
    "moderate_intensity": "moderate_intensity",
    "high_intensity": "high_intensity",
}
FLAGS = {"Hot": HEAT_FLAGS, "Cold": COLD_FLAGS}


@dataclass(frozen=True)
class Window:
    """A closed date interval of a pregnancy.

    ``start`` names the column holding its first day, ``stop`` the column
    holding the day *after* its last one (``None``: it ends on the day of
    delivery), and ``keep`` is a SQL predicate for the births it applies to.
    """

    name: str
    start: str
    stop: str | None
    keep: str
    start_label: str
    file_label: str


WINDOWS = {
    w.name: w
    for w in (
        Window("preconception", "pre", "tr1", "true", "Pre", "Preconception"),
        # a delivery before the end does not clip the first trimester
        Window("trimester1", "tr1", "tr2", "true", "Tr1", "Trimester1"),
        Window("trimester2", "tr2", "tr3", "tr3 < admd", "Tr2", "Trimester2"),
        Window("trimester2_preterm", "tr2", None, "tr3 > admd AND tr2 < admd", "Tr2", "Trimester2_Preme"),
        Window("trimester3", "tr3", None, "tr3 < admd", "Tr3", "Trimester3"),
    )
}

BIRTHS = T.StructType(
    [
        T.StructField("RFA_ID", T.LongType()),
        T.StructField("ZIP", T.IntegerType()),
        T.StructField("ADMD", T.IntegerType()),
        T.StructField("GEST", T.IntegerType()),
    ]
)


def _weather(flags: dict[str, str]) -> T.StructType:
    return T.StructType(
        [
            T.StructField("Zip", T.IntegerType()),
            T.StructField("Date", T.DateType()),
            T.StructField("TAVG", T.DoubleType()),
            *(T.StructField(flag, T.IntegerType()) for flag in flags),
        ]
    )


WEATHER = {"Hot": _weather(HEAT_FLAGS), "Cold": _weather(COLD_FLAGS)}

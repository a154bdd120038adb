"""The births of each pregnancy window, with the window's dates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climagest.operators.numbering import number_values
from climagest.schema import WINDOWS, Window
from climagest.sources.ledger import Ledger
from climagest.sources.shared import SMALL_ROWS, has_at_most

COHORT_COLUMNS = ("ZIP", "ADMD", "RFA_ID", "start", "End", "Number")


def numbered_locations(births: DataFrame, locations: DataFrame, few: bool) -> DataFrame:
    """The ``locations`` that have births, with their run id.

    The run id counts the postcodes among all births in weather postcodes,
    before any window drops births.
    """
    side = F.broadcast(locations) if few else locations
    numbers = number_values(births.join(side, "location", "left_semi"), "location", few=few)
    return F.broadcast(numbers) if few else numbers


def in_windows(
    births: DataFrame,
    windows: Sequence[Window],
    more: Callable[[Window], Mapping[str, str]] = lambda window: {},
    ledger: Ledger | None = None,
) -> DataFrame:
    """One row per birth and window it belongs to, from a single pass over the births.

    ``stop`` is the day after ``End``. ``more`` names further columns (name -> expression) of a window.
    ``ledger`` counts, as ``windows``, the rows dropped because a date is missing.
    """
    structs = ", ".join(
        f"struct('{w.name}' AS window, {w.start} AS start, {w.stop or 'date_add(admd, 1)'} AS stop, {w.keep} AS _keep"
        + "".join(f", {expression} AS {name}" for name, expression in more(w).items())
        + ")"
        for w in windows
    )
    further = list(more(windows[0])) if windows else []
    rows = births.selectExpr("location", "admd", "RFA_ID", "Number", f"inline(array({structs}))").where("_keep")
    if ledger is not None:
        rows = ledger.watch(rows, "windows", {"null_window": F.col("start").isNull() | F.col("stop").isNull()})
    return (
        rows.dropna(subset=["start", "stop", "location"])
        .selectExpr(
            "window",
            "location AS ZIP",
            "admd AS ADMD",
            "RFA_ID",
            "start",
            "date_sub(stop, 1) AS End",
            "Number",
            "stop",
            *further,
        )
    )


def window_cohort(
    births: DataFrame, weather: DataFrame, windows: Sequence[str] = tuple(WINDOWS)
) -> DataFrame:
    """Births of the named windows whose postcode has weather.

    ``births`` come from ``gestation_dates``, ``weather`` from ``prepare_weather``.
    """
    locations = weather.select("location").distinct()
    numbers = numbered_locations(births, locations, has_at_most(locations, SMALL_ROWS))
    return in_windows(births.join(numbers, "location"), [WINDOWS[name] for name in windows]).drop("stop")

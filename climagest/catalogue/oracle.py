"""SQL each query must agree with, written for the raw test tables."""

from __future__ import annotations

from climagest.catalogue.standin import FORMULAS
from climagest.functions.columns import day_names
from climagest.schema import FLAGS, WINDOWS

LAST_DAY = 393

CTES = {
    "births_raw": """
        SELECT o_orderkey AS RFA_ID,
               CAST(CASE WHEN o_custkey % 20 < 7 THEN 29401 ELSE 29001 + (o_custkey * 37) % 320 * 3 END AS INTEGER) AS ZIP,
               CAST(datediff('day', DATE '1960-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS ADMD,
               CAST(10 + o_orderkey % 38 AS INTEGER) AS GEST
        FROM orders""",
    "births_text": """
        SELECT RFA_ID,
               CASE WHEN RFA_ID % 11 = 0 THEN CAST(ZIP AS VARCHAR) || 'x'
                    WHEN RFA_ID % 13 <> 0 THEN CAST(ZIP AS VARCHAR) END AS ZIP,
               ADMD,
               CASE WHEN RFA_ID % 17 = 0 THEN 'unknown'
                    WHEN RFA_ID % 19 = 0 THEN CAST(GEST AS VARCHAR) || '.5'
                    ELSE CAST(GEST AS VARCHAR) END AS GEST
        FROM births_raw""",
    "births_any": """
        SELECT RFA_ID, ZIP AS location, CAST(DATE '1960-01-01' + CAST(ADMD AS INTEGER) AS DATE) AS admd,
               CAST(GEST AS DOUBLE) AS gest
        FROM births_raw""",
    "births": "SELECT * FROM births_any WHERE location > 29000 AND location < 29945",
    "births_parsed": """
        SELECT * FROM (
            SELECT RFA_ID, TRY_CAST(ZIP AS INTEGER) AS location,
                   CAST(DATE '1960-01-01' + CAST(ADMD AS INTEGER) AS DATE) AS admd,
                   TRY_CAST(GEST AS DOUBLE) AS gest
            FROM births_text) p
        WHERE location > 29000 AND location < 29945""",
    "dated": """
        SELECT *, CAST(admd - CAST(ceil(gest * 7) + 91 AS INTEGER) AS DATE) AS pre,
               CAST(admd - CAST(ceil(gest * 7) AS INTEGER) AS DATE) AS tr1,
               CAST(admd - CAST(ceil(gest * 7) - 91 AS INTEGER) AS DATE) AS tr2,
               CAST(admd - CAST(ceil(gest * 7) - 182 AS INTEGER) AS DATE) AS tr3,
               admd AS tr3_end
        FROM births""",
    "cohort": """
        SELECT location, RFA_ID, admd, pre, tr3_end,
               CAST(datediff('day', pre, tr3_end) + 1 AS INTEGER) AS n_days
        FROM dated WHERE datediff('day', pre, tr3_end) <= 392""",
    "temperature": """
        SELECT CAST(CASE WHEN l_partkey % 20 < 7 OR (l_partkey * 37) % 320 % 16 = 5 THEN 29401
                         ELSE 29001 + (l_partkey * 37) % 320 * 3 END AS INTEGER) AS location,
               CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS exposure
        FROM lineitem GROUP BY ALL""",
    "local_temperature": "SELECT * FROM temperature WHERE location > 29000 AND location < 29945",
    "cuts": """
        SELECT location, quantile_cont(exposure, 0.90) AS p90, quantile_cont(exposure, 0.95) AS p95,
               quantile_cont(exposure, 0.97) AS p97, quantile_cont(exposure, 0.99) AS p99,
               quantile_cont(exposure, 0.10) AS p10, quantile_cont(exposure, 0.05) AS p05,
               quantile_cont(exposure, 0.03) AS p03, quantile_cont(exposure, 0.01) AS p01
        FROM temperature GROUP BY location""",
    **{
        f"{family.lower()}_weather": "SELECT location, date, exposure AS TAVG, "
        + ", ".join(f"CAST(({rule.replace('TAVG', 'exposure')}) AS INTEGER) AS {flag}" for flag, rule in rules.items())
        + " FROM local_temperature JOIN cuts USING (location)"
        for family, rules in FORMULAS.items()
    },
    "numbers": """
        SELECT location, CAST(dense_rank() OVER (ORDER BY location) AS INTEGER) AS Number
        FROM (SELECT DISTINCT location FROM births
              WHERE location IN (SELECT location FROM local_temperature)) z""",
    "windowed": " UNION ALL ".join(
        f"""SELECT '{name}' AS "window", location AS ZIP, admd AS ADMD, RFA_ID, {start} AS start,
            CAST({end} AS DATE) AS "End", Number
            FROM dated JOIN numbers USING (location) WHERE ({keep}) AND {start} IS NOT NULL"""
        for name, start, end, keep in (
            ("preconception", "pre", "pre + 90", "true"),
            ("trimester1", "tr1", "tr1 + 90", "true"),
            ("trimester2", "tr2", "tr2 + 90", "tr3 < admd"),
            ("trimester2_preterm", "tr2", "admd", "tr3 > admd AND tr2 < admd"),
            ("trimester3", "tr3", "admd", "tr3 < admd"),
        )
    ),
    "days": """
        SELECT location, RFA_ID, admd, pre, tr3_end, CAST(i + 1 AS INTEGER) AS day_idx,
               CAST(pre + CAST(i AS INTEGER) AS DATE) AS date
        FROM (SELECT *, UNNEST(generate_series(0, n_days - 1)) AS i FROM cohort) s""",
    "exposed": "SELECT d.*, t.exposure FROM days d LEFT JOIN local_temperature t USING (location, date)",
    "percentiles": """
        SELECT location, quantile_cont(exposure, 0.95) AS percentile_95, quantile_cont(exposure, 0.90) AS percentile_90,
               quantile_cont(exposure, 0.10) AS percentile_10, quantile_cont(exposure, 0.05) AS percentile_05
        FROM temperature GROUP BY location""",
    "identified": """
        SELECT c.*, row_number() OVER (ORDER BY location, RFA_ID, admd, pre) AS Identifier
        FROM cohort c JOIN local_temperature t USING (location) WHERE t.date = c.pre""",
}

# CTEs each CTE reads; the order of CTES is one in which they can be declared.
USES = {
    "births_text": ["births_raw"],
    "births_any": ["births_raw"],
    "births": ["births_any"],
    "births_parsed": ["births_text"],
    "dated": ["births"],
    "cohort": ["dated"],
    "local_temperature": ["temperature"],
    "cuts": ["temperature"],
    "hot_weather": ["local_temperature", "cuts"],
    "cold_weather": ["local_temperature", "cuts"],
    "numbers": ["births", "local_temperature"],
    "windowed": ["dated", "numbers"],
    "days": ["cohort"],
    "exposed": ["days", "local_temperature"],
    "percentiles": ["temperature"],
    "identified": ["cohort", "local_temperature"],
}


def sql(select: str, *uses: str, **extra: str) -> str:
    """``select`` behind the CTEs it needs."""
    needed: set[str] = set()

    def need(name: str) -> None:
        needed.add(name)
        for inner in USES.get(name, ()):
            need(inner)

    for name in uses:
        need(name)
    declared = {name: body for name, body in CTES.items() if name in needed} | extra
    if not declared:
        return select
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in declared.items()) + "\n" + select


def settled(value: str, places: int = 6) -> str:
    return f"round(round({value}, {places + 4}), {places})"


def _counts(family: str, windows: tuple[str, ...]) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE w.{flag} = 1) AS {name}" for flag, name in FLAGS[family].items())
    names = ", ".join(f"'{w}'" for w in windows)
    weather = f"{family.lower()}_weather"
    # counted per distinct interval, since births sharing one share the counts
    counted = f"""
        SELECT i.ZIP, i.start, i."End", {counts}
        FROM (SELECT DISTINCT ZIP, start, "End" FROM windowed WHERE "window" IN ({names})) i
        LEFT JOIN {weather} w ON w.location = i.ZIP AND w.date BETWEEN i.start AND i."End"
        GROUP BY ALL"""
    return sql(
        f"""SELECT w.*, {", ".join(f"c.{n}" for n in FLAGS[family].values())}
        FROM windowed w JOIN counted c ON w.ZIP = c.ZIP AND w.start = c.start AND w."End" = c."End"
        WHERE w."window" IN ({names})""",
        "windowed",
        weather,
        counted=counted,
    )


# the n-th postcode of a flag, and the n-th run of one postcode where rows lie month by month
_RANKED = "SELECT '{name}' AS flag, date, dense_rank() OVER (ORDER BY location) AS run FROM {weather} WHERE {flag} = 1"
_RUNS = """SELECT '{name}' AS flag, date, 1 + sum(changed) OVER (ORDER BY date_trunc('month', date), location, date) AS run
    FROM (SELECT date, location, CASE WHEN location <> lag(location) OVER (ORDER BY date_trunc('month', date), location, date)
                                      THEN 1 ELSE 0 END AS changed FROM {weather} WHERE {flag} = 1) c"""


def _ordinal_counts(family: str, numbered: str) -> str:
    flags = FLAGS[family]
    weather = f"{family.lower()}_weather"
    ranked = " UNION ALL ".join(numbered.format(name=name, flag=flag, weather=weather) for flag, name in flags.items())
    counted = f"""
        SELECT i.Number, i.start, i."End",
               {", ".join(f"count(*) FILTER (WHERE r.flag = '{n}') AS {n}" for n in flags.values())}
        FROM (SELECT DISTINCT Number, start, "End" FROM windowed) i
        LEFT JOIN ranked r ON r.run = i.Number AND r.date BETWEEN i.start AND i."End"
        GROUP BY ALL"""
    return sql(
        f"""SELECT w.*, {", ".join(f"c.{n}" for n in flags.values())}
        FROM windowed w JOIN counted c ON w.Number = c.Number AND w.start = c.start AND w."End" = c."End" """,
        "windowed",
        weather,
        ranked=ranked,
        counted=counted,
    )


def _wide(first: int, last: int) -> str:
    days = enumerate(day_names(first, last), start=first)
    return ", ".join(f"max(CASE WHEN day_idx = {k} THEN exposure END) AS {name}" for k, name in days)


def _bands(first: int, last: int) -> str:
    def inside(condition: str) -> str:
        return f"avg(exposure) FILTER (WHERE exposure {condition})"

    def complete(mean: str) -> str:
        return f"CASE WHEN count(exposure) = {last - first + 1} THEN {mean} END"

    return f"""
        SELECT RFA_ID, location,
          {settled(complete(inside("< percentile_05")))} AS mean_below_5th,
          {settled(inside("BETWEEN percentile_05 AND percentile_10"))} AS mean_5th_to_10th,
          {settled(inside("BETWEEN percentile_10 AND percentile_90"))} AS mean_10th_to_90th,
          {settled(inside("BETWEEN percentile_90 AND percentile_95"))} AS mean_90th_to_95th,
          {settled(complete(inside("> percentile_95")))} AS mean_above_95th,
          Identifier
        FROM (SELECT i.RFA_ID, i.location, i.Identifier, e.exposure, p.*
              FROM identified i JOIN percentiles p USING (location)
              LEFT JOIN exposed e ON e.RFA_ID = i.RFA_ID AND e.day_idx BETWEEN {first} AND {last}) x
        GROUP BY RFA_ID, location, Identifier"""


def _band_query(first: int, last: int, select: str = "SELECT * FROM means") -> str:
    return sql(select, "identified", "percentiles", "exposed", means=_bands(first, last))


_ROUNDED_PERCENTILES = ", ".join(f"{settled('percentile_' + p)} AS percentile_{p}" for p in ("95", "90", "10", "05"))

_DAY_SUMMARY = f"""
    SELECT location, day_idx, count(*) AS n_births, count(exposure) AS n_exposed,
           {settled("sum(exposure)", 2)} AS sum_exposure, {settled("min(exposure)")} AS min_exposure,
           {settled("max(exposure)")} AS max_exposure, {settled("sum(exposure * (RFA_ID % 97))", 2)} AS marked_exposure"""

_NESTED = "SELECT location, RFA_ID, admd, pre, n_days FROM cohort"

ORACLE: dict[str, str] = {
    "births_clean": sql("SELECT * FROM births", "births"),
    "births_clean_text": sql("SELECT * FROM births_parsed", "births_parsed"),
    "births_from_csv": sql("SELECT CAST(RFA_ID AS VARCHAR) AS RFA_ID, location, admd, gest FROM births_parsed", "births_parsed"),
    "births_from_csv_dates": sql(
        "SELECT RFA_ID, location, CASE WHEN RFA_ID % 5 = 0 OR RFA_ID % 7 <> 0 THEN admd END AS admd, gest FROM births", "births"
    ),
    "births_csv_checked": """
        SELECT CASE WHEN RFA_ID % 29 = 0 OR RFA_ID % 31 = 0 THEN 'line' ELSE 'row' END AS kind,
               CASE WHEN RFA_ID % 29 = 0 THEN RFA_ID || ';' || ZIP
                    WHEN RFA_ID % 31 = 0 THEN RFA_ID || ';' || ZIP || ';' || ADMD || ';' || GEST || ';more;fields'
                    ELSE RFA_ID || ',' || ZIP || ',' || ADMD || ',' || GEST END AS text
        FROM (""" + CTES["births_raw"] + ") b",
    "cleaning_ledger": sql(
        """SELECT 'births' AS "table", reason, n FROM (
             SELECT count(*) AS rows, count(*) FILTER (ZIP IS NULL) AS zip_missing,
               count(*) FILTER (ZIP IS NOT NULL AND TRY_CAST(ZIP AS INTEGER) IS NULL) AS zip_malformed,
               count(*) FILTER (GEST IS NULL) AS gest_missing,
               count(*) FILTER (GEST IS NOT NULL AND TRY_CAST(GEST AS DOUBLE) IS NULL) AS gest_malformed,
               count(*) FILTER (NOT (TRY_CAST(ZIP AS INTEGER) > 29000 AND TRY_CAST(ZIP AS INTEGER) < 29945)) AS zip_out_of_bounds
             FROM births_text) t
           UNPIVOT (n FOR reason IN (rows, zip_missing, zip_malformed, gest_missing, gest_malformed, zip_out_of_bounds))
           UNION ALL
           SELECT 'windows', reason, n FROM (
             SELECT CAST(sum(2 + CASE WHEN tr3 < admd THEN 2 ELSE 0 END + CASE WHEN tr3 > admd AND tr2 < admd THEN 1 ELSE 0 END) AS BIGINT) AS rows,
               2 * count(*) FILTER (pre IS NULL) AS null_window
             FROM dated_text WHERE location IN (SELECT location FROM local_temperature)) w
           UNPIVOT (n FOR reason IN (rows, null_window))""",
        "births_text", "births_parsed", "local_temperature",
        dated_text=CTES["dated"].replace("FROM births", "FROM births_parsed"),
    ),
    "weather_text_zip": sql(
        f"""SELECT location, date, {settled('exposure')} AS exposure FROM local_temperature WHERE day(date) <> 13""",
        "local_temperature",
    ),
    "weather_clean": sql(
        f"SELECT location, date, {settled('exposure')} AS exposure FROM local_temperature", "local_temperature"
    ),
    "gestation_dates": sql("SELECT * FROM dated", "dated"),
    "gestation_dates_text": sql(
        "SELECT * FROM dated_text", "births_parsed", dated_text=CTES["dated"].replace("FROM births", "FROM births_parsed")
    ),
    "exposure_births": sql("SELECT * FROM cohort", "cohort"),
    "births_with_weather": sql(
        "SELECT * FROM births b WHERE EXISTS (SELECT 1 FROM local_temperature t WHERE t.location = b.location)",
        "births",
        "local_temperature",
    ),
    "zip_frequency": sql("SELECT location, count(*) AS N FROM local_temperature GROUP BY location", "local_temperature"),
    "any_zip_column_filter": sql(
        """SELECT * FROM (SELECT *, CAST(28801 + RFA_ID % 9 * 200 AS INTEGER) AS HOSPITAL_ZIP FROM births_raw) b
        WHERE ZIP IN (SELECT location FROM local_temperature)
           OR HOSPITAL_ZIP IN (SELECT location FROM local_temperature)""",
        "births_raw",
        "local_temperature",
    ),
    **{
        f"flag_days_{family.lower()}_{flag}": sql(
            f"SELECT date, {flag}, location FROM {family.lower()}_weather WHERE {flag} = 1", f"{family.lower()}_weather"
        )
        for family, flags in FLAGS.items()
        for flag in flags
    },
    "epoch_dates": sql(
        """SELECT RFA_ID, admd, CAST(datediff('day', DATE '1970-01-01', admd) AS INTEGER) AS unix_day,
        admd AS admd_again FROM births_any""",
        "births_any",
    ),
    "zip_run_id": sql(
        """SELECT location, date, CAST(1 + sum(changed) OVER (ORDER BY location, date) AS INTEGER) AS Number
        FROM (SELECT location, date, CASE WHEN location <> lag(location) OVER (ORDER BY location, date)
                                          THEN 1 ELSE 0 END AS changed
              FROM temperature) c""",
        "temperature",
    ),
    "zip_run_id_unsorted": sql(
        """SELECT RFA_ID, location, location_step,
               CAST(1 + sum(CASE WHEN location_step <> 0 THEN 1 ELSE 0 END) OVER (ORDER BY RFA_ID) AS INTEGER) AS Number
        FROM (SELECT RFA_ID, location, location - lag(location) OVER (ORDER BY RFA_ID) AS location_step
              FROM births) c""",
        "births",
    ),
    "birth_row_numbers": sql(
        """SELECT location, RFA_ID, admd, pre,
               row_number() OVER (PARTITION BY location ORDER BY RFA_ID, admd, pre) AS "row",
               row_number() OVER (ORDER BY location, RFA_ID, admd, pre) AS Identifier
        FROM cohort""",
        "cohort",
    ),
    "birth_row_numbers_repeated": sql(
        """SELECT RFA_ID, ZIP, ADMD, GEST,
               row_number() OVER (ORDER BY ZIP, RFA_ID, ADMD * 7 % 31, ADMD, GEST) AS Identifier
        FROM (SELECT CAST(RFA_ID // 4 AS BIGINT) AS RFA_ID, ZIP, ADMD, GEST
              FROM (SELECT * FROM births_raw
                    UNION ALL SELECT RFA_ID, ZIP, ADMD, GEST + 2 FROM births_raw WHERE RFA_ID % 3 = 0) r
              WHERE ZIP > 29000 AND ZIP < 29945) b""",
        "births_raw",
    ),
    "longest_spans": sql(
        """SELECT location, max(n_days) AS max_days FROM cohort GROUP BY location
        UNION ALL SELECT NULL, max(n_days) FROM cohort""",
        "cohort",
    ),
    **{
        f"cohort_{name}": sql(f"""SELECT * FROM windowed WHERE "window" = '{name}'""", "windowed") for name in WINDOWS
    },
    **{f"{family.lower()}_counts_{name}": _counts(family, (name,)) for family in FLAGS for name in WINDOWS},
    **{f"{family.lower()}_counts_all": _counts(family, tuple(WINDOWS)) for family in FLAGS},
    **{
        f"hot_counts_{form}": _counts("Hot", tuple(WINDOWS)) for form in ("interval", "bucketed", "spine", "shuffled", "sweep")
    },
    **{f"{family.lower()}_counts_ordinal": _ordinal_counts(family, _RANKED) for family in FLAGS},
    "hot_counts_file_order": _ordinal_counts("Hot", _RUNS),
    "hot_window_files": _counts("Hot", tuple(WINDOWS)),
    "cold_window_files": _counts("Cold", tuple(WINDOWS)),
    "hot_counts_by_window": _counts("Hot", tuple(WINDOWS)),
    "csv_roundtrip": "SELECT * EXCLUDE (\"window\", start), start AS Pre FROM ("
    + _counts("Cold", ("preconception",))
    + ") counts",
    "day_spine": sql(
        """SELECT location, day_idx, count(*) AS n_births, min(date) AS first_date, max(date) AS last_date,
        CAST(sum(datediff('day', DATE '1970-01-01', date)) AS BIGINT) AS sum_of_days,
        CAST(sum(datediff('day', DATE '1970-01-01', date) * (RFA_ID % 97)) AS BIGINT) AS marked_days
        FROM days GROUP BY location, day_idx""",
        "days",
    ),
    "day_exposure": sql(f"{_DAY_SUMMARY} FROM exposed GROUP BY location, day_idx", "exposed"),
    "day_exposure_attached": sql(
        f"{_DAY_SUMMARY} FROM exposed GROUP BY location, day_idx", "exposed"
    ),
    "day_exposure_padded": sql(
        f"""SELECT c.location, CAST(p.position AS INTEGER) AS position,
               count(CASE WHEN p.position < n_days THEN 1 END) AS n_dates,
               count(CASE WHEN p.position >= n_days THEN 1 END) AS n_padded,
               min(CASE WHEN p.position < n_days THEN CAST(pre + CAST(p.position AS INTEGER) AS DATE) END) AS first_date,
               max(CASE WHEN p.position < n_days THEN CAST(pre + CAST(p.position AS INTEGER) AS DATE) END) AS last_date
        FROM (SELECT *, UNNEST(generate_series(0, {LAST_DAY - 1})) AS position FROM cohort) p
        JOIN (SELECT DISTINCT location FROM cohort) c USING (location) GROUP BY ALL""",
        "cohort",
    ),
    "exposure_calculation": sql(
        f"""SELECT location, birth_row, RFA_ID, admd, count(*) AS n_days, count(exposure) AS n_exposed,
               min(date) AS first_date, {settled("avg(exposure)")} AS mean_exposure,
               {settled("max(exposure)")} AS max_exposure
        FROM exposed JOIN (SELECT RFA_ID, row_number() OVER (PARTITION BY location ORDER BY RFA_ID) AS birth_row
                           FROM cohort) r USING (RFA_ID)
        GROUP BY ALL""",
        "exposed",
    ),
    "exposure_of_flag": sql(
        f"""{_DAY_SUMMARY} FROM (SELECT d.*, CAST(w.Heatwave_days AS DOUBLE) AS exposure
                                 FROM days d LEFT JOIN hot_weather w USING (location, date)) e
        GROUP BY location, day_idx""",
        "days",
        "hot_weather",
    ),
    "exposure_wide_other_column": sql(
        f"SELECT location, RFA_ID, admd, pre, tr3_end, {_wide(1, LAST_DAY)} FROM doubled GROUP BY ALL",
        "exposed",
        doubled="SELECT * REPLACE (exposure * 2 AS exposure) FROM exposed",
    ),
    "exposure_wide_file": sql(
        f"SELECT location, RFA_ID, admd, pre, tr3_end, {_wide(1, LAST_DAY)} FROM exposed GROUP BY ALL", "exposed"
    ),
    "exposure_wide": sql(
        f"SELECT location, RFA_ID, admd, pre, tr3_end, {_wide(1, LAST_DAY)} FROM exposed GROUP BY ALL", "exposed"
    ),
    "exposure_wide_trimester1": sql(
        f"SELECT location, RFA_ID, {_wide(92, 182)} FROM exposed GROUP BY ALL", "exposed"
    ),
    "exposure_wide_missing": sql(
        f"""SELECT location, RFA_ID,
        CAST({len([n for n in day_names(1, LAST_DAY) if n.startswith("Day_1")])}
             - count(exposure) FILTER (WHERE CAST(day_idx AS VARCHAR) LIKE '1%') AS INTEGER) AS empty_by_prefix,
        CAST({len([n for n in day_names(1, LAST_DAY) if n.startswith("Day_9")])}
             - count(exposure) FILTER (WHERE CAST(day_idx AS VARCHAR) LIKE '9%') AS INTEGER) AS empty_by_pattern
        FROM exposed GROUP BY location, RFA_ID""",
        "exposed",
    ),
    "exposure_pivot": sql(
        f"SELECT location, RFA_ID, admd, pre, tr3_end, {_wide(1, LAST_DAY)} FROM exposed GROUP BY ALL", "exposed"
    ),
    "exposure_unpivot": sql(
        f"""SELECT c.location, 'Day_' || k AS name, count(*) AS n_births, count(e.exposure) AS n_exposed,
               {settled("sum(e.exposure)", 2)} AS sum_value,
               {settled("sum(e.exposure * (c.RFA_ID % 97))", 2)} AS marked_value
        FROM (SELECT *, UNNEST(generate_series(1, {LAST_DAY})) AS k FROM cohort) c
        LEFT JOIN exposed e ON e.RFA_ID = c.RFA_ID AND e.day_idx = c.k
        GROUP BY c.location, k""",
        "cohort",
        "exposed",
    ),
    "nested_by_location": sql(_NESTED, "cohort"),
    "nested_sizes": sql(
        """SELECT location, CAST((r - 1) // 1000 AS INTEGER) AS piece, count(*) AS n_births
        FROM (SELECT location, row_number() OVER (PARTITION BY location ORDER BY RFA_ID) AS r FROM cohort) n
        GROUP BY ALL""",
        "cohort",
    ),
    "grouped_map_streaks": sql(
        """SELECT location, CAST(sum(n) AS BIGINT) AS n_days, CAST(max(rises) AS BIGINT) AS longest_rise
        FROM (SELECT location, run, count(*) AS n, count(*) - 1 AS rises
              FROM (SELECT location, date, sum(CASE WHEN exposure > before AND date = day_before + 1 THEN 0 ELSE 1 END)
                           OVER (PARTITION BY location ORDER BY date) AS run
                    FROM (SELECT location, date, exposure, lag(exposure) OVER w AS before, lag(date) OVER w AS day_before
                          FROM local_temperature WINDOW w AS (PARTITION BY location ORDER BY date)) l) r
              GROUP BY location, run) g
        GROUP BY location""",
        "local_temperature",
    ),
    **{
        name: sql(f"SELECT location, {_ROUNDED_PERCENTILES} FROM percentiles", "percentiles")
        for name in ("location_percentiles", "location_percentiles_sorted", "location_percentiles_selected")
    },
    **{
        name: sql(
            f"""SELECT location, {_ROUNDED_PERCENTILES}, RFA_ID, admd, pre, tr3_end,
                   {", ".join(day_names(1, LAST_DAY))}, Identifier
            FROM wide JOIN percentiles USING (location) JOIN (SELECT RFA_ID, Identifier FROM identified) i USING (RFA_ID)""",
            "exposed",
            "percentiles",
            "identified",
            wide=f"SELECT location, RFA_ID, admd, pre, tr3_end, {_wide(1, LAST_DAY)} FROM exposed GROUP BY ALL",
        )
        for name in ("percentile_dataset", "percentile_dataset_partitioned")
    },
    "thresholds_distinct": sql(
        f"""SELECT location, {_ROUNDED_PERCENTILES} FROM percentiles
        WHERE location IN (SELECT location FROM identified)""",
        "percentiles",
        "identified",
    ),
    "band_means_pre": _band_query(1, 91),
    "band_means_tr2": _band_query(183, 273),
    "band_means_first_14": _band_query(1, 14),
    "band_means_from_wide": _band_query(1, 91),
    "partition_roundtrip": _band_query(1, 91, "SELECT *, location AS zip_part FROM means"),
    "partition_replace": _band_query(
        1, 91, "SELECT * REPLACE (Identifier + CASE WHEN location IN (29401, 29112) THEN 1000000 ELSE 0 END AS Identifier) FROM means"
    ),
    "band_means_from_partition": _band_query(1, 91, "SELECT * FROM means WHERE location = 29401"),
    "one_location": _band_query(1, 91, "SELECT * FROM means WHERE location = 29401"),
    "location_list": sql("SELECT DISTINCT location AS zip_part FROM identified", "identified"),
}

"""Manufacturing template plans (lineitem as production log), with DuckDB oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from sparkwright.operators import controls as C
from sparkwright.operators import manufacturing as M
from sparkwright.sources.fixtures import MANUFACTURING_MAPPING, MANUFACTURING_ROW_KEY, manufacturing_raw


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.prepare(manufacturing_raw(spark, sf_dir), MANUFACTURING_MAPPING, MANUFACTURING_ROW_KEY)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct records: KPI tables need no duplicate flag on every row."""
    return M.records(manufacturing_raw(spark, sf_dir), MANUFACTURING_MAPPING)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.analysis_rows(records(spark, sf_dir))


START, END, SHIFTS = dt.date(1996, 1, 1), dt.date(1997, 12, 31), ["Day"]


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis rows inside one date range and one choice of shifts."""
    first = C.filter_date_range(rows(spark, sf_dir), "timestamp", START, END)
    return C.filter_values(first, {"shift": SHIFTS})


QUERIES = {
    "mfg_prepare": prepared,
    "mfg_issue_summary": lambda s, d: M.issue_summary(records(s, d)),
    "mfg_kpis": lambda s, d: M.kpis(rows(s, d)),
    "mfg_machine_performance": lambda s, d: M.machine_performance(rows(s, d)),
    "mfg_output_over_time": lambda s, d: M.over_time(rows(s, d), "actual_output"),
    "mfg_downtime_over_time": lambda s, d: M.over_time(rows(s, d), "downtime_minutes"),
    "mfg_output_by_line": lambda s, d: M.by_optional(rows(s, d), "line"),
    "mfg_output_by_shift": lambda s, d: M.by_optional(rows(s, d), "shift"),
    "mfg_controlled_trend": lambda s, d: M.controlled_trend(rows(s, d), "scrap_rate"),
    "mfg_controlled_attainment": lambda s, d: M.controlled_trend(rows(s, d), "production_attainment"),
    "mfg_controlled_trend_chosen": lambda s, d: M.controlled_trend(chosen(s, d), "scrap_rate"),
    "mfg_machine_ranking_chosen": lambda s, d: M.machine_ranking(chosen(s, d), "downtime_minutes", 10),
    "mfg_machine_ranking": lambda s, d: M.machine_ranking(rows(s, d), "downtime_minutes", 10),
}

PREPARED = """
mfg_raw AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_shipdate AS event_time,
    CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN NULL ELSE 'M' || CAST(l_suppkey AS VARCHAR) END AS machine,
    l_quantity AS output, l_quantity * l_discount * CAST(2.0 AS DOUBLE) AS scrap, l_linenumber * 5 AS downtime,
    l_quantity * (CAST(1.0 AS DOUBLE) + l_tax) AS target_output, 480 AS runtime,
    'Line ' || l_linestatus AS production_line,
    CASE l_returnflag WHEN 'A' THEN 'Day' WHEN 'R' THEN 'Night' END AS shift_name,
    'P' || CAST(l_partkey AS VARCHAR) AS sku,
    CASE WHEN l_discount >= 0.09 THEN 'Review' ELSE 'Pass' END AS inspection_status
  FROM lineitem
),
mfg_typed AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey,
    CAST(event_time AS VARCHAR) AS original_timestamp, event_time AS "timestamp",
    NULLIF(TRIM(machine), '') AS machine_id, NULLIF(TRIM(production_line), '') AS line,
    NULLIF(TRIM(shift_name), '') AS shift, NULLIF(TRIM(sku), '') AS product,
    NULLIF(TRIM(inspection_status), '') AS quality_status,
    CAST(output AS DOUBLE) AS actual_output, CAST(scrap AS DOUBLE) AS scrap_count,
    CAST(downtime AS DOUBLE) AS downtime_minutes, CAST(target_output AS DOUBLE) AS planned_output,
    CAST(runtime AS DOUBLE) AS runtime_minutes
  FROM mfg_raw
),
mfg_dup AS (
  SELECT *, row_number() OVER (PARTITION BY "timestamp", machine_id, line, shift, product, planned_output,
      actual_output, scrap_count, downtime_minutes, runtime_minutes, quality_status
      ORDER BY l_orderkey, l_partkey, l_linenumber, l_suppkey) > 1 AS is_duplicate_row
  FROM mfg_typed
),
mfg_prepared AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, "timestamp", machine_id, actual_output, scrap_count,
    downtime_minutes, planned_output, runtime_minutes, line, shift, product, quality_status, original_timestamp,
    is_duplicate_row,
    machine_id IS NULL AS is_missing_machine,
    (original_timestamp IS NOT NULL AND "timestamp" IS NULL) AS is_invalid_timestamp,
    (actual_output IS NULL OR COALESCE(actual_output < 0, false)) AS is_invalid_output,
    (scrap_count IS NULL OR COALESCE(scrap_count < 0, false)) AS is_invalid_scrap,
    COALESCE(actual_output > 0 AND scrap_count / actual_output > 0.15, false) AS is_high_scrap,
    (downtime_minutes IS NULL OR COALESCE(downtime_minutes < 0, false)) AS is_invalid_downtime,
    COALESCE(planned_output IS NOT NULL AND planned_output <= 0, false) AS is_zero_planned_output,
    shift IS NULL AS is_missing_shift,
    ("timestamp" IS NOT NULL AND machine_id IS NOT NULL
      AND NOT (actual_output IS NULL OR COALESCE(actual_output < 0, false))
      AND NOT (scrap_count IS NULL OR COALESCE(scrap_count < 0, false))
      AND NOT (downtime_minutes IS NULL OR COALESCE(downtime_minutes < 0, false))
      AND NOT is_duplicate_row) AS is_analysis_valid
  FROM mfg_dup
),
mfg_rows AS (SELECT * FROM mfg_prepared WHERE is_analysis_valid)"""

D = "CAST({} AS DECIMAL(38,12))"


def _d(c: str) -> str:
    return D.format(c)


ISSUES = [
    ("Duplicate rows", "is_duplicate_row", "Medium", "Duplicate production records are excluded from KPI calculations."),
    ("Missing machine IDs", "is_missing_machine", "High",
     "Rows cannot be attributed to a machine and are excluded from KPI calculations."),
    ("Timestamp parsing issues", "is_invalid_timestamp", "High",
     "Rows are excluded from time-series analytics until timestamps are corrected."),
    ("Invalid output values", "is_invalid_output", "High", "Rows are excluded from output KPIs."),
    ("Invalid scrap values", "is_invalid_scrap", "High", "Rows are excluded from scrap KPIs."),
    ("High scrap observations", "is_high_scrap", "Business review", "Rows are retained but should be investigated."),
    ("Invalid downtime values", "is_invalid_downtime", "High", "Rows are excluded from downtime KPIs."),
    ("Zero or missing planned output", "is_zero_planned_output", "Medium",
     "Rows are excluded from attainment calculations."),
    ("Missing shift values", "is_missing_shift", "Low", "Rows remain in core KPIs but are not useful for shift cuts."),
]


def issue_sql(ctes: str, table: str, issues) -> str:
    parts = [f"SELECT '{label}' AS issue, CAST(count(*) FILTER (WHERE {flag}) AS BIGINT) AS row_count, "
             f"'{sev}' AS severity, '{note}' AS analysis_handling FROM {table}"
             for label, flag, sev, note in issues]
    return "WITH " + ctes + " " + " UNION ALL ".join(parts)


def _rate(num: str, den: str, scale: int = 4) -> str:
    return f"CASE WHEN {den} > 0 THEN ROUND(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE), {scale}) END"


KPI_T = """mfg_t AS (
  SELECT COALESCE(SUM({ao}), 0) AS out_, COALESCE(SUM({sc}), 0) AS scrap, COALESCE(SUM({dm}), 0) AS down,
    COUNT(DISTINCT machine_id) AS machines,
    COALESCE(SUM(CASE WHEN planned_output IS NOT NULL AND planned_output > 0 THEN {po} END), 0) AS plan,
    COALESCE(SUM(CASE WHEN planned_output IS NOT NULL AND planned_output > 0 THEN {ao} END), 0) AS plan_out,
    COALESCE(SUM(CASE WHEN runtime_minutes IS NOT NULL AND runtime_minutes >= 0 THEN {rm} END), 0) AS run,
    COALESCE(SUM(CASE WHEN runtime_minutes IS NOT NULL AND runtime_minutes >= 0 THEN {dm} END), 0) AS run_down
  FROM mfg_rows),
mfg_r AS (
  SELECT *, CASE WHEN plan <> 0 THEN {att} END AS att,
    CASE WHEN run + run_down > 0 THEN {avail} END AS avail, {quality} AS quality
  FROM mfg_t)""".format(
    ao=_d("actual_output"), sc=_d("scrap_count"), dm=_d("downtime_minutes"), po=_d("planned_output"),
    rm=_d("runtime_minutes"), att=_rate("plan_out", "plan"), avail=_rate("run", "run + run_down"),
    quality=_rate("out_ - scrap", "out_"))

ORACLE = {
    "mfg_prepare": "WITH " + PREPARED + " SELECT * FROM mfg_prepared",
    "mfg_issue_summary": issue_sql(PREPARED, "mfg_prepared", ISSUES),
    "mfg_kpis": "WITH " + PREPARED + ", " + KPI_T + """
      SELECT CAST(ROUND(out_, 2) AS DOUBLE) AS total_output, CAST(ROUND(scrap, 2) AS DOUBLE) AS total_scrap,
        """ + _rate("scrap", "out_") + """ AS scrap_rate,
        CAST(ROUND(down, 2) AS DOUBLE) AS total_downtime_minutes,
        CASE WHEN machines > 0 THEN ROUND(CAST(down AS DOUBLE) / machines, 2) ELSE 0.0 END
          AS average_downtime_per_machine,
        att AS production_attainment, avail AS availability_approximation, quality AS quality_rate_approximation,
        CAST(ROUND(CAST(att AS DECIMAL(12,4)) * CAST(avail AS DECIMAL(12,4)) * CAST(quality AS DECIMAL(12,4)), 4)
          AS DOUBLE) AS simplified_oee_approximation
      FROM mfg_r""",
    "mfg_machine_performance": "WITH " + PREPARED + """,
      a AS (SELECT machine_id, SUM(""" + _d("actual_output") + """) AS o, SUM(""" + _d("scrap_count") + """) AS s,
              SUM(""" + _d("downtime_minutes") + """) AS d, COUNT(*) AS record_count FROM mfg_rows GROUP BY machine_id)
      SELECT machine_id, CAST(ROUND(o, 4) AS DOUBLE) AS total_output, CAST(ROUND(s, 4) AS DOUBLE) AS total_scrap,
        COALESCE(""" + _rate("s", "o") + """, 0.0) AS scrap_rate, CAST(ROUND(d, 4) AS DOUBLE) AS downtime_minutes,
        record_count
      FROM a""",
    "mfg_output_over_time": "WITH " + PREPARED + """
      SELECT date_trunc('day', "timestamp") AS period,
        CAST(ROUND(SUM(""" + _d("actual_output") + """), 2) AS DOUBLE) AS actual_output
      FROM mfg_rows GROUP BY 1""",
    "mfg_downtime_over_time": "WITH " + PREPARED + """
      SELECT date_trunc('day', "timestamp") AS period,
        CAST(ROUND(SUM(""" + _d("downtime_minutes") + """), 2) AS DOUBLE) AS downtime_minutes
      FROM mfg_rows GROUP BY 1""",
    "mfg_output_by_line": "WITH " + PREPARED + """
      SELECT line, CAST(ROUND(SUM(""" + _d("actual_output") + """), 2) AS DOUBLE) AS actual_output
      FROM mfg_rows WHERE line IS NOT NULL GROUP BY line""",
    "mfg_output_by_shift": "WITH " + PREPARED + """
      SELECT shift, CAST(ROUND(SUM(""" + _d("actual_output") + """), 2) AS DOUBLE) AS actual_output
      FROM mfg_rows WHERE shift IS NOT NULL GROUP BY shift""",
    "mfg_controlled_trend": "WITH " + PREPARED + """,
      a AS (SELECT date_trunc('day', "timestamp") AS period, SUM(""" + _d("actual_output") + """) AS o,
              SUM(""" + _d("scrap_count") + """) AS s FROM mfg_rows GROUP BY 1)
      SELECT period, COALESCE(CASE WHEN o <> 0 THEN CAST(ROUND(CAST(CAST(s AS DOUBLE) / CAST(o AS DOUBLE) AS DECIMAL(28,10)), 4) AS DOUBLE) END, 0.0) AS value
      FROM a""",
    "mfg_controlled_attainment": "WITH " + PREPARED + """,
      a AS (SELECT date_trunc('day', "timestamp") AS period, SUM(""" + _d("actual_output") + """) AS o,
              SUM(""" + _d("planned_output") + """) AS p FROM mfg_rows GROUP BY 1)
      SELECT period, COALESCE(CASE WHEN p <> 0 THEN CAST(ROUND(CAST(CAST(o AS DOUBLE) / CAST(p AS DOUBLE) AS DECIMAL(28,10)), 4) AS DOUBLE) END, 0.0) AS value
      FROM a""",
    "mfg_machine_ranking": "WITH " + PREPARED + """,
      a AS (SELECT machine_id, COALESCE(SUM(""" + _d("actual_output") + """), 0) AS o,
              COALESCE(SUM(""" + _d("scrap_count") + """), 0) AS s,
              COALESCE(SUM(""" + _d("downtime_minutes") + """), 0) AS d,
              COALESCE(SUM(""" + _d("planned_output") + """), 0) AS p FROM mfg_rows GROUP BY machine_id)
      SELECT machine_id, CAST(ROUND(o, 2) AS DOUBLE) AS actual_output, CAST(ROUND(s, 2) AS DOUBLE) AS scrap_count,
        CAST(ROUND(d, 2) AS DOUBLE) AS downtime_minutes, CAST(ROUND(p, 2) AS DOUBLE) AS planned_output,
        COALESCE(CASE WHEN o <> 0 THEN CAST(ROUND(CAST(CAST(s AS DOUBLE) / CAST(o AS DOUBLE) AS DECIMAL(28,10)), 4) AS DOUBLE) END, 0.0) AS scrap_rate,
        COALESCE(CASE WHEN p <> 0 THEN CAST(ROUND(CAST(CAST(o AS DOUBLE) / CAST(p AS DOUBLE) AS DECIMAL(28,10)), 4) AS DOUBLE) END, 0.0)
          AS production_attainment
      FROM a ORDER BY downtime_minutes DESC, machine_id LIMIT 10""",
}

CHOSEN = """,
mfg_chosen AS (SELECT * FROM mfg_rows WHERE "timestamp" >= TIMESTAMP '1996-01-01' AND "timestamp" < TIMESTAMP '1998-01-01'
  AND shift IN (""" + ", ".join(f"'{x}'" for x in SHIFTS) + "))"
for _name in ("mfg_controlled_trend", "mfg_machine_ranking"):
    _rest = ORACLE[_name][len("WITH " + PREPARED):]
    ORACLE[_name + "_chosen"] = "WITH " + PREPARED + CHOSEN + _rest.replace("mfg_rows", "mfg_chosen")

"""Quality plans: template rules, severity summary, issue rows and scores, with DuckDB oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import quality as Q
from sparkwright.sources import fixtures as FX
from sparkwright.sources.readers import read_table
from sparkwright.templates import RULE_TEMPLATE_LABELS

SOURCES = {
    "sales_retail": (FX.retail_raw, FX.RETAIL_MAPPING, FX.RETAIL_ROW_KEY),
    "manufacturing": (FX.manufacturing_raw, FX.MANUFACTURING_MAPPING, FX.MANUFACTURING_ROW_KEY),
    "logistics": (FX.logistics_raw, FX.LOGISTICS_MAPPING, FX.LOGISTICS_ROW_KEY),
    "finance": (FX.finance_raw, FX.FINANCE_MAPPING, FX.FINANCE_ROW_KEY),
}
RETAIL_DATA = ["InvoiceNo", "InvoiceDate", "CustomerID", "Description", "Category", "Quantity", "UnitPrice",
               "Country", "Status"]


def rules_for(tid: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        build, mapping, _ = SOURCES[tid]
        return Q.template_rules(build(spark, sf_dir), tid, mapping)
    return run


def rules_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [rules_for(t)(spark, sf_dir) for t in SOURCES])


def retail_with_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.plans.profile import raw_with_id
    return raw_with_id(spark, sf_dir)


def retail_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.template_score(FX.retail_raw(spark, sf_dir), "sales_retail", FX.RETAIL_MAPPING, FX.RETAIL_ROW_KEY)


QUERIES = {
    "quality_rules_retail": rules_for("sales_retail"),
    "quality_rules_manufacturing": rules_for("manufacturing"),
    "quality_rules_logistics": rules_for("logistics"),
    "quality_rules_finance": rules_for("finance"),
    "quality_rules_all": rules_all,
    "rule_severity_summary": lambda s, d: Q.severity_summary(rules_all(s, d)),
    "quality_issue_rows": lambda s, d: Q.issue_rows(retail_with_id(s, d), "sales_retail", FX.RETAIL_MAPPING),
    "quality_issue_rows_single": lambda s, d: Q.issue_rows(retail_with_id(s, d), "sales_retail", FX.RETAIL_MAPPING,
                                                           rule_name="unit_price <= 0"),
    "generic_issue_rows": lambda s, d: Q.generic_issue_rows(
        retail_with_id(s, d).select("source_row_id", *RETAIL_DATA)),
    "quality_score": retail_score,
    "quality_score_generic": lambda s, d: Q.score(read_table(s, d, "events")),
    "quality_report_table": lambda s, d: Q.score_report(retail_score(s, d)),
}

# ---- Oracle ---------------------------------------------------------------------------------

from sparkwright.plans.finance import PREPARED as _FIN  # noqa: E402,F401
from sparkwright.plans.retail import RAW as RETAIL_RAW  # noqa: E402

MFG_RAW = """mfg_raw AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_shipdate AS event_time,
    CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN NULL ELSE 'M' || CAST(l_suppkey AS VARCHAR) END AS machine,
    l_quantity AS output, l_quantity * l_discount * CAST(2.0 AS DOUBLE) AS scrap, l_linenumber * 5 AS downtime,
    l_quantity * (CAST(1.0 AS DOUBLE) + l_tax) AS target_output, 480 AS runtime FROM lineitem)"""
LOG_RAW = """log_raw AS (
  SELECT l.l_orderkey, o.o_orderdate AS order_date,
    CASE WHEN NOT (l.l_returnflag = 'N' AND l.l_linestatus = 'O') THEN l.l_shipdate END AS delivered_at,
    o.o_orderdate + INTERVAL 60 DAY AS promised_date, s.s_name AS courier,
    l.l_extendedprice * l.l_tax AS freight_cost
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""
FIN_RAW = """fin_raw AS (
  SELECT strftime(o_orderdate, '%Y-%m-%d') AS posting_date, o_totalprice AS amount,
    CASE o_orderstatus WHEN 'F' THEN 'Revenue' WHEN 'O' THEN 'Expense' ELSE 'unknown' END AS entry_type,
    o_totalprice * CAST(0.9 AS DOUBLE) AS budget_amount, o_totalprice AS actual_amount FROM orders)"""


def _parse(c: str) -> str:
    return f"COALESCE(try_strptime(TRIM({c}), '%Y-%m-%d'), try_strptime(TRIM({c}), '%m/%d/%Y'))"


def _blank(c: str) -> str:
    return f"({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '')"


MASKS = {
    "sales_retail": ("retail_raw", RETAIL_RAW, [
        f"{_parse(chr(34) + 'InvoiceDate' + chr(34))} IS NULL", '"Quantity" = 0', '"Quantity" < 0',
        '"UnitPrice" <= 0', _blank('"CustomerID"'), _blank('"Description"')]),
    "manufacturing": ("mfg_raw", MFG_RAW, [
        "CAST(output AS DOUBLE) < 0", "CAST(scrap AS DOUBLE) > CAST(output AS DOUBLE)", "CAST(downtime AS DOUBLE) < 0",
        "CAST(target_output AS DOUBLE) <= 0", _blank("machine"), "event_time IS NULL"]),
    "logistics": ("log_raw", LOG_RAW, [
        "delivered_at < order_date", "delivered_at IS NULL", "promised_date IS NULL", "freight_cost < 0",
        _blank("courier")]),
    "finance": ("fin_raw", FIN_RAW, [
        "amount IS NULL", "amount = 0", f"{_parse('posting_date')} IS NULL",
        "NOT COALESCE(lower(trim(entry_type)) IN ('revenue', 'income', 'sales', 'cost', 'expense', 'spend', 'cogs'), false)",
        "(budget_amount IS NULL AND budget_amount IS NOT NULL) OR (actual_amount IS NULL AND actual_amount IS NOT NULL)"]),
}


def _esc(s: str) -> str:
    return s.replace("'", "''")


def _rules_select(tid: str) -> str:
    table, _, masks = MASKS[tid]
    label = RULE_TEMPLATE_LABELS[tid]
    parts = []
    for rule, mask in zip(Q.RULES[tid], masks):
        cnt = f"COUNT(*) FILTER (WHERE COALESCE({mask}, false))"
        parts.append(f"SELECT '{_esc(label)}' AS template, '{_esc(rule.name)}' AS rule_name, '{rule.severity}' AS severity, "
                     f"{cnt} AS affected_rows_count, ROUND(CAST({cnt} AS DOUBLE) / GREATEST(COUNT(*), 1) * 100, 2) "
                     f"AS affected_percentage, '{_esc(rule.explanation)}' AS explanation, "
                     f"'{_esc(rule.fix)}' AS recommended_fix FROM {table}")
    return " UNION ALL ".join(parts)


ALL_CTES = ", ".join(MASKS[t][1] for t in SOURCES)
ALL_RULES = " UNION ALL ".join(_rules_select(t) for t in SOURCES)

RETAIL_ID = RETAIL_RAW + """,
retail_id AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_linenumber, l_suppkey) - 1 AS source_row_id
              FROM retail_raw)"""
RAW_COLS = ["l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"] + RETAIL_DATA
_QC = ", ".join(f'"{c}"' for c in RAW_COLS)


def _issue_sql(only: str | None = None) -> str:
    _, _, masks = MASKS["sales_retail"]
    masks = [m.replace("retail_raw", "retail_id") for m in masks]
    parts = [f"SELECT source_row_id AS source_row_index, '{_esc(r.name)}' AS rule_name, '{r.severity}' AS severity, "
             f"{_QC} FROM retail_id WHERE COALESCE({m}, false)"
             for r, m in zip(Q.RULES["sales_retail"], masks) if only is None or r.name == only]
    return "WITH " + RETAIL_ID + " " + " UNION ALL ".join(parts)


_DC = ", ".join(f'"{c}"' for c in RETAIL_DATA)
_ANY_NULL = " OR ".join(f'"{c}" IS NULL' for c in RETAIL_DATA)

GENERIC_ISSUES = "WITH " + RETAIL_ID + f""",
  g AS (SELECT *, COUNT(*) OVER (PARTITION BY {_DC}) AS copies FROM retail_id)
  SELECT source_row_id AS source_row_index, 'row contains missing values' AS rule_name, 'warning' AS severity, {_DC}
  FROM g WHERE {_ANY_NULL}
  UNION ALL
  SELECT source_row_id AS source_row_index, 'duplicate row' AS rule_name, 'warning' AS severity, {_DC}
  FROM g WHERE copies > 1"""


def _score_sql() -> str:
    missing = " + ".join(f'COUNT(*) FILTER (WHERE "{c}" IS NULL)' for c in RETAIL_DATA)
    date = _parse('"InvoiceDate"')
    return "WITH " + RETAIL_RAW + f""",
      f AS (SELECT COUNT(*) AS "rows", {missing} AS missing_cells,
              COUNT("Quantity") + COUNT("UnitPrice") AS numeric_checked,
              COUNT(*) FILTER (WHERE "Quantity" = 0) + COUNT(*) FILTER (WHERE "UnitPrice" <= 0) AS invalid_numeric_count,
              COUNT("InvoiceDate") AS date_checked,
              COUNT(*) FILTER (WHERE "InvoiceDate" IS NOT NULL AND {date} IS NULL) AS date_parse_failures
            FROM retail_raw),
      d AS (SELECT COALESCE(SUM(n - 1), 0) AS duplicate_row_count FROM (SELECT COUNT(*) AS n FROM retail_raw GROUP BY {_DC})),
      s AS (SELECT *,
        ROUND(GREATEST(0.0, LEAST(100.0, (1.0 - CAST(missing_cells AS DOUBLE) / GREATEST("rows" * 9, 1)) * 100)), 1) AS ms,
        ROUND(GREATEST(0.0, LEAST(100.0, (1.0 - CAST(duplicate_row_count AS DOUBLE) / GREATEST("rows", 1)) * 100)), 1) AS ds,
        ROUND(GREATEST(0.0, LEAST(100.0, (1.0 - CAST(invalid_numeric_count AS DOUBLE) / GREATEST(numeric_checked, 1)) * 100)), 1) AS ns,
        100.0 AS ss,
        ROUND(GREATEST(0.0, LEAST(100.0, (1.0 - CAST(date_parse_failures AS DOUBLE) / GREATEST(date_checked, 1)) * 100)), 1) AS dts
        FROM f, d)
      SELECT ROUND((((ms * 0.25 + ds * 0.15) + ns * 0.2) + ss * 0.25 + dts * 0.15) / 1.0, 1) AS overall_score,
        ms AS missing_values_score, ds AS duplicate_rows_score, ns AS invalid_numeric_values_score,
        CAST(ss AS DOUBLE) AS schema_completeness_score, dts AS date_parsing_score, "rows" AS row_count,
        "rows" * 9 AS total_cells, missing_cells, CAST(duplicate_row_count AS BIGINT) AS duplicate_rows,
        invalid_numeric_count, numeric_checked, date_parse_failures, date_checked
      FROM s"""


def _generic_score_sql() -> str:
    cols = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    missing = " + ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL)" for c in cols)
    return f"""
      WITH f AS (SELECT COUNT(*) AS "rows", {missing} AS missing_cells,
              COUNT(event_id) + COUNT(user_id) + COUNT(*) FILTER (WHERE value IS NOT NULL AND NOT isnan(value))
                AS numeric_checked,
              COUNT(*) FILTER (WHERE abs(value) = 'inf'::DOUBLE) AS invalid_numeric_count FROM events),
      d AS (SELECT COALESCE(SUM(n - 1), 0) AS duplicate_row_count FROM (SELECT COUNT(*) AS n FROM events GROUP BY event_id, ts, user_id, event_type, value, props)),
      s AS (SELECT *,
        ROUND(GREATEST(0.0, LEAST(100.0, (1.0 - CAST(missing_cells AS DOUBLE) / GREATEST("rows" * 6, 1)) * 100)), 1) AS ms,
        ROUND(GREATEST(0.0, LEAST(100.0, (1.0 - CAST(duplicate_row_count AS DOUBLE) / GREATEST("rows", 1)) * 100)), 1) AS ds,
        ROUND(GREATEST(0.0, LEAST(100.0, (1.0 - CAST(invalid_numeric_count AS DOUBLE) / GREATEST(numeric_checked, 1)) * 100)), 1) AS ns
        FROM f, d)
      SELECT ROUND(((ms * 0.25 + ds * 0.15) + ns * 0.2) / 0.6, 1) AS overall_score, ms AS missing_values_score,
        ds AS duplicate_rows_score, ns AS invalid_numeric_values_score, CAST(NULL AS DOUBLE) AS schema_completeness_score,
        CAST(NULL AS DOUBLE) AS date_parsing_score, "rows" AS row_count, "rows" * 6 AS total_cells, missing_cells,
        CAST(duplicate_row_count AS BIGINT) AS duplicate_rows, invalid_numeric_count, numeric_checked,
        CAST(0 AS BIGINT) AS date_parse_failures, CAST(0 AS BIGINT) AS date_checked FROM s"""


ORACLE = {
    "quality_rules_retail": "WITH " + RETAIL_RAW + " " + _rules_select("sales_retail"),
    "quality_rules_manufacturing": "WITH " + MFG_RAW + " " + _rules_select("manufacturing"),
    "quality_rules_logistics": "WITH " + LOG_RAW + " " + _rules_select("logistics"),
    "quality_rules_finance": "WITH " + FIN_RAW + " " + _rules_select("finance"),
    "quality_rules_all": "WITH " + ALL_CTES + " " + ALL_RULES,
    "rule_severity_summary": "WITH " + ALL_CTES + ", r AS (" + ALL_RULES + """),
      lv(severity) AS (VALUES ('critical'), ('warning'), ('info'))
      SELECT lv.severity, COUNT(r.rule_name) AS rule_count, COUNT(*) FILTER (WHERE r.affected_rows_count > 0) AS violated_rules,
        CAST(COALESCE(SUM(r.affected_rows_count), 0) AS BIGINT) AS affected_rows FROM lv LEFT JOIN r ON r.severity = lv.severity
      GROUP BY lv.severity""",
    "quality_issue_rows": _issue_sql(),
    "quality_issue_rows_single": _issue_sql("unit_price <= 0"),
    "generic_issue_rows": GENERIC_ISSUES,
    "quality_score": _score_sql(),
    "quality_score_generic": _generic_score_sql(),
}


def _report_sql() -> str:
    def pct(n: str, d: str) -> str:
        return f"format('{{:.1f}}', ROUND(CAST({n} AS DOUBLE) / GREATEST({d}, 1) * 100, 1)) || '%'"
    rows = [("overall", "overall_score", "CAST(overall_score AS VARCHAR)"),
            ("sub_score", "missing_values", "CAST(missing_values_score AS VARCHAR)"),
            ("sub_score", "duplicate_rows", "CAST(duplicate_rows_score AS VARCHAR)"),
            ("sub_score", "invalid_numeric_values", "CAST(invalid_numeric_values_score AS VARCHAR)"),
            ("sub_score", "schema_completeness", "CAST(schema_completeness_score AS VARCHAR)"),
            ("sub_score", "date_parsing", "CAST(date_parsing_score AS VARCHAR)")]
    rows += [("metric", m, f"CAST({m} AS VARCHAR)") for m in
             ["missing_cells", "duplicate_rows", "invalid_numeric_count", "date_parse_failures"]]
    rows += [
        ("explanation", "note", "'Missing values: ' || missing_cells || ' missing cells across ' || total_cells || "
         "' total cells (' || " + pct("missing_cells", "total_cells") + " || ').'"),
        ("explanation", "note", "'Duplicate rows: ' || duplicate_rows || ' duplicate rows out of ' || row_count || "
         "' rows (' || " + pct("duplicate_rows", "row_count") + " || ').'"),
        ("explanation", "note", "'Invalid numeric values: ' || invalid_numeric_count || ' issues across ' || "
         "GREATEST(numeric_checked, 1) || ' checked values.'"),
        ("explanation", "note", "'Schema completeness: ' || format('{:.1f}', schema_completeness_score) || "
         "'% of required template fields are mapped.'"),
        ("explanation", "note", "'Date parsing: ' || date_parse_failures || ' failures across ' || "
         "GREATEST(date_checked, 1) || ' checked date values.'"),
    ]
    fixes = [
        "CASE WHEN missing_values_score < 95 THEN 'Review high-missing columns and decide whether to impute, "
        "backfill, or exclude them.' END",
        "CASE WHEN duplicate_rows > 0 THEN 'Investigate duplicate rows before KPI reporting; keep an audit trail "
        "if removing them.' END",
        "CASE WHEN invalid_numeric_count > 0 THEN 'Correct or exclude invalid numeric values such as non-numeric "
        "quantities or unit prices <= 0.' END",
        "CASE WHEN schema_completeness_score < 100 THEN 'Complete required field mapping before using "
        "domain-specific analytics.' END",
        "CASE WHEN date_parse_failures > 0 THEN 'Standardize date formats or provide explicit parsing rules.' END",
    ]
    parts = [f"SELECT '{sct}' AS section, '{m}' AS metric, {v} AS value FROM s" for sct, m, v in rows]
    fixes_sql = (f"SELECT 'recommended_fix' AS section, 'fix' AS metric, unnest(CASE WHEN len(f) > 0 THEN f ELSE "
                 f"['No major data quality issues were detected by the current rules.'] END) AS value FROM "
                 f"(SELECT list_filter([{', '.join(fixes)}], lambda x: x IS NOT NULL) AS f FROM s)")
    return f"WITH s AS ({_score_sql()}) " + " UNION ALL ".join(parts + [fixes_sql])


ORACLE["quality_report_table"] = _report_sql()

"""Finance template plans (orders as ledger entries), with DuckDB oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import controls as C
from sparkwright.operators import finance as FN
from sparkwright.plans.manufacturing import issue_sql
from sparkwright.sources.fixtures import FINANCE_MAPPING, FINANCE_ROW_KEY, finance_raw


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FN.prepare(finance_raw(spark, sf_dir), FINANCE_MAPPING, FINANCE_ROW_KEY)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct records: KPI tables need no duplicate flag on every row."""
    return FN.records(finance_raw(spark, sf_dir), FINANCE_MAPPING)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FN.analysis_rows(records(spark, sf_dir))


def _category_of(kind: str):
    return lambda s, d: FN.category_summary(rows(s, d)).filter(F.col("normalized_type") == kind)


START, END, CATEGORIES = dt.date(1996, 1, 1), dt.date(1997, 12, 31), ["1-URGENT", "2-HIGH", "5-LOW"]


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis rows inside one date range and one choice of categories."""
    first = C.filter_date_range(rows(spark, sf_dir), "date", START, END)
    return C.filter_values(first, {"category": CATEGORIES})


QUERIES = {
    "fin_prepare": prepared,
    "fin_issue_summary": lambda s, d: FN.issue_summary(records(s, d)),
    "fin_kpis": lambda s, d: FN.kpis(rows(s, d)),
    "fin_monthly_summary": lambda s, d: FN.monthly_summary(rows(s, d)),
    "fin_category_summary": lambda s, d: FN.category_summary(rows(s, d)),
    "fin_cost_by_category": _category_of("cost"),
    "fin_revenue_by_category": _category_of("revenue"),
    "fin_cost_center_summary": lambda s, d: FN.cost_center_summary(rows(s, d)),
    "fin_largest_transactions": lambda s, d: FN.largest_transactions(FN.analysis_rows(prepared(s, d))),
    "fin_budget_vs_actual": lambda s, d: FN.budget_vs_actual(rows(s, d)),
    "fin_controlled_monthly": lambda s, d: FN.controlled_monthly(rows(s, d)),
    "fin_controlled_monthly_chosen": lambda s, d: FN.controlled_monthly(chosen(s, d)),
    "fin_category_ranking_chosen": lambda s, d: FN.category_ranking(chosen(s, d), "net_result", 10),
    "fin_category_ranking": lambda s, d: FN.category_ranking(rows(s, d), "net_result", 10),
}

PREPARED = """
fin_raw AS (
  SELECT o.o_orderkey, CAST(o.o_orderkey AS VARCHAR) AS journal_id,
    strftime(o.o_orderdate, '%Y-%m-%d') AS posting_date, o.o_totalprice AS amount,
    CASE o.o_orderstatus WHEN 'F' THEN 'Revenue' WHEN 'O' THEN 'Expense' ELSE 'unknown' END AS entry_type,
    o.o_orderpriority AS expense_category, c.c_name AS account_name, c.c_mktsegment AS business_unit,
    o.o_totalprice * CAST(0.9 AS DOUBLE) AS budget_amount, o.o_totalprice AS actual_amount
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
),
fin_typed AS (
  SELECT o_orderkey,
    NULLIF(TRIM(journal_id), '') AS transaction_id, NULLIF(TRIM(entry_type), '') AS "type",
    NULLIF(TRIM(expense_category), '') AS category, NULLIF(TRIM(account_name), '') AS account,
    NULLIF(TRIM(business_unit), '') AS cost_center,
    posting_date AS original_date,
    COALESCE(try_strptime(TRIM(posting_date), '%Y-%m-%d'), try_strptime(TRIM(posting_date), '%m/%d/%Y')) AS "date",
    CAST(amount AS DOUBLE) AS amount, CAST(budget_amount AS DOUBLE) AS budget, CAST(actual_amount AS DOUBLE) AS actual
  FROM fin_raw
),
fin_dup AS (
  SELECT *, row_number() OVER (PARTITION BY transaction_id, "date", amount, "type", category, account, cost_center,
      budget, actual ORDER BY o_orderkey) > 1 AS is_duplicate_row,
    CASE WHEN lower(trim("type")) IN ('revenue', 'income', 'sales') THEN 'revenue'
         WHEN lower(trim("type")) IN ('cost', 'expense', 'spend', 'cogs') THEN 'cost' END AS normalized_type
  FROM fin_typed
),
fin_prepared AS (
  SELECT o_orderkey, transaction_id, "date", amount, "type", category, account, cost_center, budget, actual,
    original_date, normalized_type, is_duplicate_row,
    (original_date IS NOT NULL AND "date" IS NULL) AS is_invalid_date,
    amount IS NULL AS is_invalid_amount,
    COALESCE(amount, 0.0) = 0 AS is_zero_amount,
    normalized_type IS NULL AS is_uninterpretable_type,
    category IS NULL AS is_missing_category,
    abs(amount) AS abs_amount,
    CASE WHEN COALESCE(normalized_type = 'revenue', false) THEN abs(amount) ELSE -abs(amount) END AS signed_result,
    (transaction_id IS NOT NULL AND "date" IS NOT NULL AND amount IS NOT NULL AND NOT (COALESCE(amount, 0.0) = 0)
      AND normalized_type IS NOT NULL AND NOT is_duplicate_row) AS is_analysis_valid
  FROM fin_dup
),
fin_rows AS (SELECT * FROM fin_prepared WHERE is_analysis_valid)"""

ABS = "CAST(abs_amount AS DECIMAL(38,6))"
REV = f"COALESCE(SUM(CASE WHEN normalized_type = 'revenue' THEN {ABS} END), 0)"
COST = f"COALESCE(SUM(CASE WHEN normalized_type = 'cost' THEN {ABS} END), 0)"


def r2(x: str) -> str:
    return f"CAST(ROUND({x}, 2) AS DOUBLE)"


ISSUES = [
    ("Duplicate rows", "is_duplicate_row", "Medium", "Duplicate transactions are excluded from KPI calculations."),
    ("Date parsing issues", "is_invalid_date", "High", "Rows are excluded from time-series analytics."),
    ("Invalid amounts", "is_invalid_amount", "High", "Rows are excluded from KPI calculations."),
    ("Zero amounts", "is_zero_amount", "Medium", "Rows are excluded from financial totals."),
    ("Uninterpretable type values", "is_uninterpretable_type", "High",
     "Rows are excluded because revenue/cost meaning is ambiguous."),
    ("Missing categories", "is_missing_category", "Low",
     "Rows remain in totals but are less useful for category reporting."),
]

CATEGORY_SUMMARY = PREPARED + f""",
fin_category AS (
  SELECT COALESCE(category, 'Missing') AS category, normalized_type, {r2(f"SUM({ABS})")} AS amount,
    COUNT(DISTINCT transaction_id) AS transaction_count
  FROM fin_rows GROUP BY 1, 2)"""

MEASURES = f"""{REV} AS revenue, {COST} AS cost, COALESCE(SUM({ABS}), 0) AS amount,
    COALESCE(SUM(CAST(budget AS DECIMAL(38,6))), 0) AS budget, COALESCE(SUM(CAST(actual AS DECIMAL(38,6))), 0) AS actual"""
MEASURE_OUT = (f"{r2('revenue')} AS revenue, {r2('cost')} AS cost, {r2('amount')} AS amount, {r2('budget')} AS budget, "
               f"{r2('actual')} AS actual, {r2('revenue - cost')} AS net_result, "
               f"{r2('actual - budget')} AS budget_variance")

ORACLE = {
    "fin_prepare": "WITH " + PREPARED + " SELECT * FROM fin_prepared",
    "fin_issue_summary": issue_sql(PREPARED, "fin_prepared", ISSUES),
    "fin_kpis": "WITH " + PREPARED + f""",
      t AS (SELECT {REV} AS rev, {COST} AS cost, COUNT(*) AS n, AVG({ABS}) AS avg_abs,
              COALESCE(SUM(CASE WHEN budget IS NOT NULL AND actual IS NOT NULL
                THEN CAST(actual AS DECIMAL(38,6)) - CAST(budget AS DECIMAL(38,6)) END), 0) AS var FROM fin_rows)
      SELECT {r2('rev')} AS total_revenue, {r2('cost')} AS total_cost, {r2('rev - cost')} AS net_result,
        CASE WHEN rev <> 0 THEN ROUND(CAST(rev - cost AS DOUBLE) / CAST(rev AS DOUBLE), 4) ELSE 0.0 END AS margin,
        CAST(n AS DOUBLE) AS transaction_count,
        COALESCE(CAST(ROUND(avg_abs, 2) AS DOUBLE), 0.0) AS average_transaction_amount,
        {r2('var')} AS budget_variance
      FROM t""",
    "fin_monthly_summary": "WITH " + PREPARED + f"""
      SELECT date_trunc('month', "date") AS month, {r2(REV)} AS revenue, {r2(COST)} AS cost,
        {r2(REV + ' - ' + COST)} AS net_result
      FROM fin_rows GROUP BY 1""",
    "fin_category_summary": "WITH " + CATEGORY_SUMMARY + " SELECT * FROM fin_category",
    "fin_cost_by_category": "WITH " + CATEGORY_SUMMARY + " SELECT * FROM fin_category WHERE normalized_type = 'cost'",
    "fin_revenue_by_category": "WITH " + CATEGORY_SUMMARY +
    " SELECT * FROM fin_category WHERE normalized_type = 'revenue'",
    "fin_cost_center_summary": "WITH " + PREPARED + f"""
      SELECT COALESCE(cost_center, 'Missing') AS cost_center, {r2(REV)} AS revenue, {r2(COST)} AS cost,
        COUNT(DISTINCT transaction_id) AS transaction_count, {r2(REV + ' - ' + COST)} AS net_result
      FROM fin_rows GROUP BY 1""",
    "fin_largest_transactions": "WITH " + PREPARED +
    " SELECT * FROM fin_rows ORDER BY abs_amount DESC, transaction_id LIMIT 25",
    "fin_budget_vs_actual": "WITH " + PREPARED + f"""
      SELECT cost_center, {r2('SUM(CAST(budget AS DECIMAL(38,6)))')} AS budget,
        {r2('SUM(CAST(actual AS DECIMAL(38,6)))')} AS actual
      FROM fin_rows WHERE budget IS NOT NULL AND actual IS NOT NULL GROUP BY cost_center""",
    "fin_controlled_monthly": "WITH " + PREPARED + f""",
      t AS (SELECT date_trunc('month', "date") AS period, {MEASURES} FROM fin_rows GROUP BY 1)
      SELECT period, {MEASURE_OUT} FROM t""",
    "fin_category_ranking": "WITH " + PREPARED + f""",
      t AS (SELECT COALESCE(category, 'Missing') AS category, {MEASURES} FROM fin_rows GROUP BY 1)
      SELECT category, {MEASURE_OUT} FROM t ORDER BY net_result DESC, category LIMIT 10""",
}

CHOSEN = """,
fin_chosen AS (SELECT * FROM fin_rows WHERE "date" >= TIMESTAMP '1996-01-01' AND "date" < TIMESTAMP '1998-01-01'
  AND category IN (""" + ", ".join(f"'{x}'" for x in CATEGORIES) + "))"
for _name in ("fin_controlled_monthly", "fin_category_ranking"):
    _rest = ORACLE[_name][len("WITH " + PREPARED):]
    ORACLE[_name + "_chosen"] = "WITH " + PREPARED + CHOSEN + _rest.replace("fin_rows", "fin_chosen")

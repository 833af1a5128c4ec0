"""Finance template: type normalisation, KPIs, monthly/category/cost-center tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.functions import clean_text, money, parse_dates, to_number
from sparkwright.operators.common import apply_mapping, distinct_records, flag_duplicates
from sparkwright.operators.manufacturing import issue_table
from sparkwright.sources.sinks import stage_table
from sparkwright.templates import COST_TYPES, FINANCE_OPTIONAL, FINANCE_REQUIRED, REVENUE_TYPES

FIELDS = FINANCE_REQUIRED + FINANCE_OPTIONAL
TEXT_FIELDS = ["transaction_id", "type", "category", "account", "cost_center"]
NUMERIC_FIELDS = ["amount", "budget", "actual"]
MEASURES = ["revenue", "cost", "amount", "budget", "actual", "net_result", "budget_variance"]


def _dtype(raw: DataFrame, mapping: dict, field: str) -> T.DataType:
    src = mapping.get(field)
    return raw.schema[src].dataType if src and src in raw.columns else T.StringType()


def normalize_type(c: Column) -> Column:
    norm = F.lower(F.trim(c))
    return F.when(norm.isin(REVENUE_TYPES), "revenue").when(norm.isin(COST_TYPES), "cost")


def _typed(raw: DataFrame, mapping: dict[str, str | None], order_cols: list[str]) -> DataFrame:
    base = apply_mapping(raw, mapping, FIELDS, keep=order_cols)
    return base.select(
        *[clean_text(f).alias(f) for f in TEXT_FIELDS],
        F.col("date").cast("string").alias("original_date"),
        parse_dates("date", _dtype(raw, mapping, "date")).alias("date"),
        *[to_number(f, _dtype(raw, mapping, f)).alias(f) for f in NUMERIC_FIELDS],
        *order_cols,
    )


def prepare(raw: DataFrame, mapping: dict[str, str | None], order_cols: list[str]) -> DataFrame:
    """Every row with its flags; rows are identified by ``order_cols``. The typed rows are written once, as the flag reads them twice."""
    return _flagged(flag_duplicates(stage_table(_typed(raw, mapping, order_cols), "finance"), FIELDS, order_cols), [*order_cols, *FIELDS, "original_date"])


def records(raw: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Distinct records with their flags and ``copies``: what the KPI tables are made of."""
    found = distinct_records(_typed(raw, mapping, []), FIELDS, ["original_date"])
    return _flagged(found.withColumn("original_date", F.when(F.col("n_original_date") > 0, F.lit(""))), [*FIELDS, "copies", "n_original_date"])


def _flagged(flagged: DataFrame, kept: list[str]) -> DataFrame:
    ntype = normalize_type(F.col("type"))
    amount = F.col("amount")
    invalid_amount = amount.isNull()
    zero_amount = F.coalesce(amount, F.lit(0.0)) == 0
    abs_amount = F.abs(amount)
    return flagged.select(
        *kept,
        ntype.alias("normalized_type"),
        "is_duplicate_row",
        (F.col("original_date").isNotNull() & F.col("date").isNull()).alias("is_invalid_date"),
        invalid_amount.alias("is_invalid_amount"),
        zero_amount.alias("is_zero_amount"),
        ntype.isNull().alias("is_uninterpretable_type"),
        F.col("category").isNull().alias("is_missing_category"),
        abs_amount.alias("abs_amount"),
        F.when(F.coalesce(ntype == "revenue", F.lit(False)), abs_amount).otherwise(-abs_amount)
        .alias("signed_result"),
        (F.col("transaction_id").isNotNull() & F.col("date").isNotNull() & ~invalid_amount & ~zero_amount
         & ntype.isNotNull() & ~F.col("is_duplicate_row")).alias("is_analysis_valid"),
    )


def analysis_rows(prepared: DataFrame) -> DataFrame:
    return prepared.filter("is_analysis_valid")


def _typed_sum(kind: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("normalized_type") == kind, money("abs_amount"))), F.lit(0))


def _r2(c: Column) -> Column:
    return F.round(c, 2).cast("double")


def kpis(rows: DataFrame) -> DataFrame:
    both = F.col("budget").isNotNull() & F.col("actual").isNotNull()
    t = rows.agg(
        _typed_sum("revenue").alias("rev"),
        _typed_sum("cost").alias("cost"),
        F.count(F.lit(1)).alias("n"),
        F.avg(money("abs_amount")).alias("avg_abs"),
        F.coalesce(F.sum(F.when(both, money("actual") - money("budget"))), F.lit(0)).alias("var"),
    )
    net = F.col("rev") - F.col("cost")
    return t.select(
        _r2(F.col("rev")).alias("total_revenue"),
        _r2(F.col("cost")).alias("total_cost"),
        _r2(net).alias("net_result"),
        F.when(F.col("rev") != 0, F.round(net.cast("double") / F.col("rev").cast("double"), 4))
        .otherwise(F.lit(0.0)).alias("margin"),
        F.col("n").cast("double").alias("transaction_count"),
        F.coalesce(F.round("avg_abs", 2).cast("double"), F.lit(0.0)).alias("average_transaction_amount"),
        _r2(F.col("var")).alias("budget_variance"),
    )


def monthly_summary(rows: DataFrame) -> DataFrame:
    """Month x type pivot with the two type values fixed, zero-filled, plus net result."""
    pivot = (rows.groupBy(F.date_trunc("month", "date").alias("month"))
             .pivot("normalized_type", ["revenue", "cost"])
             .agg(F.sum(money("abs_amount"))))
    rev = F.coalesce(F.col("revenue"), F.lit(0))
    cost = F.coalesce(F.col("cost"), F.lit(0))
    return pivot.select("month", _r2(rev).alias("revenue"), _r2(cost).alias("cost"), _r2(rev - cost).alias("net_result"))


def category_summary(rows: DataFrame) -> DataFrame:
    return (rows.groupBy(F.coalesce("category", F.lit("Missing")).alias("category"), "normalized_type")
            .agg(_r2(F.sum(money("abs_amount"))).alias("amount"),
                 F.count_distinct("transaction_id").alias("transaction_count")))


def cost_center_summary(rows: DataFrame) -> DataFrame:
    t = (rows.groupBy(F.coalesce("cost_center", F.lit("Missing")).alias("cost_center"))
         .agg(_typed_sum("revenue").alias("r"), _typed_sum("cost").alias("c"),
              F.count_distinct("transaction_id").alias("transaction_count")))
    return t.select("cost_center", _r2(F.col("r")).alias("revenue"), _r2(F.col("c")).alias("cost"),
                    "transaction_count", _r2(F.col("r") - F.col("c")).alias("net_result"))


def largest_transactions(rows: DataFrame, n: int = 25) -> DataFrame:
    return rows.orderBy(F.desc("abs_amount"), "transaction_id").limit(n)


def budget_vs_actual(rows: DataFrame) -> DataFrame:
    valid = rows.filter(F.col("budget").isNotNull() & F.col("actual").isNotNull())
    return valid.groupBy("cost_center").agg(_r2(F.sum(money("budget"))).alias("budget"),
                                            _r2(F.sum(money("actual"))).alias("actual"))


def _measure_table(grouped) -> DataFrame:
    t = grouped.agg(
        _typed_sum("revenue").alias("revenue"), _typed_sum("cost").alias("cost"),
        F.coalesce(F.sum(money("abs_amount")), F.lit(0)).alias("amount"),
        F.coalesce(F.sum(money("budget")), F.lit(0)).alias("budget"),
        F.coalesce(F.sum(money("actual")), F.lit(0)).alias("actual"))
    return t


def controlled_monthly(rows: DataFrame) -> DataFrame:
    t = _measure_table(rows.groupBy(F.date_trunc("month", "date").alias("period")))
    return t.select("period", *[_r2(F.col(c)).alias(c) for c in ["revenue", "cost", "amount", "budget", "actual"]],
                    _r2(F.col("revenue") - F.col("cost")).alias("net_result"),
                    _r2(F.col("actual") - F.col("budget")).alias("budget_variance"))


def category_ranking(rows: DataFrame, measure: str = "net_result", n: int = 10) -> DataFrame:
    t = _measure_table(rows.groupBy(F.coalesce("category", F.lit("Missing")).alias("category")))
    table = t.select("category", *[_r2(F.col(c)).alias(c) for c in ["revenue", "cost", "amount", "budget", "actual"]],
                     _r2(F.col("revenue") - F.col("cost")).alias("net_result"),
                     _r2(F.col("actual") - F.col("budget")).alias("budget_variance"))
    return table.orderBy(F.desc(measure), "category").limit(n)


def issue_summary(prepared: DataFrame) -> DataFrame:
    # Issue labels, severities and handling notes.
    return issue_table(prepared, [
        ("Duplicate rows", "is_duplicate_row", "Medium", "Duplicate transactions are excluded from KPI calculations."),
        ("Date parsing issues", "is_invalid_date", "High", "Rows are excluded from time-series analytics."),
        ("Invalid amounts", "is_invalid_amount", "High", "Rows are excluded from KPI calculations."),
        ("Zero amounts", "is_zero_amount", "Medium", "Rows are excluded from financial totals."),
        ("Uninterpretable type values", "is_uninterpretable_type", "High",
         "Rows are excluded because revenue/cost meaning is ambiguous."),
        ("Missing categories", "is_missing_category", "Low",
         "Rows remain in totals but are less useful for category reporting."),
    ], {"is_invalid_date": "n_original_date"})

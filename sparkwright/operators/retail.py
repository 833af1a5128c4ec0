"""Retail / sales template: preparation flags, KPI tables, RFM segmentation.

Plan shape: one projection (mapping, casts, flags), one aggregation to distinct records, then
one aggregate per output; only the row-level table joins a duplicate flag back. Distinct order counts are computed in two stages
(per order, then per output key) so a hot order is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.functions import as_bool_flag, clean_text, money, parse_dates, to_number
from sparkwright.operators.common import apply_mapping, attach_row, distinct_records, flag_duplicates
from sparkwright.operators.manufacturing import flag_count
from sparkwright.operators.ranking import average_percent_rank
from sparkwright.sources.sinks import stage_table
from sparkwright.templates import RETAIL_OPTIONAL, RETAIL_REQUIRED

RETAIL_FIELDS = RETAIL_REQUIRED + RETAIL_OPTIONAL
DUPLICATE_FIELDS = ["order_id", "order_date", "customer_id", "product_name", "product_category",
                    "quantity", "unit_price", "country", "invoice_status"]
# Status words that mark a cancelled invoice.
CANCEL_PATTERN = "cancel|void|rejected"

_TEXT_FIELDS = ["order_id", "customer_id", "product_name", "country", "product_category", "invoice_status"]


def _dtype(raw: DataFrame, mapping: dict, field: str) -> T.DataType | None:
    src = mapping.get(field)
    return raw.schema[src].dataType if src and src in raw.columns else T.StringType()


def _typed(raw: DataFrame, mapping: dict[str, str | None], order_cols: list[str]) -> DataFrame:
    base = apply_mapping(raw, mapping, RETAIL_FIELDS, keep=order_cols)
    qty = to_number("quantity", _dtype(raw, mapping, "quantity"))
    price = to_number("unit_price", _dtype(raw, mapping, "unit_price"))
    return base.select(
        *[clean_text(f).alias(f) if f in _TEXT_FIELDS else F.col(f) for f in RETAIL_FIELDS if f not in
          ("order_date", "quantity", "unit_price")],
        F.col("order_date").cast("string").alias("original_order_date"),
        parse_dates("order_date", _dtype(raw, mapping, "order_date")).alias("order_date"),
        qty.alias("quantity"),
        price.alias("unit_price"),
        *order_cols,
    )


def prepare(raw: DataFrame, mapping: dict[str, str | None], order_cols: list[str]) -> DataFrame:
    """Canonical columns + flags + revenues; no row is dropped."""
    flagged = flag_duplicates(stage_table(_typed(raw, mapping, order_cols), "retail"), DUPLICATE_FIELDS, order_cols)
    return _flagged(flagged, order_cols, ["original_order_date"])


def records(raw: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Distinct records with their flags, revenues and ``copies``: what the KPI tables are made of."""
    found = distinct_records(_typed(raw, mapping, []), DUPLICATE_FIELDS, ["original_order_date"])
    found = found.withColumn("original_order_date", F.when(F.col("n_original_order_date") > 0, F.lit("")))
    return _flagged(found, [], ["copies", "n_original_order_date"])


def _flagged(flagged: DataFrame, before: list[str], kept: list[str]) -> DataFrame:
    q, p, d = F.col("quantity"), F.col("unit_price"), F.col("order_date")
    status = F.lower(F.coalesce(F.col("invoice_status"), F.lit("")))
    dup = F.col("is_duplicate_row")
    cancelled = status.rlike(CANCEL_PATTERN)
    valid = d.isNotNull() & q.isNotNull() & p.isNotNull() & as_bool_flag((q > 0) & (p > 0)) & ~cancelled & ~dup
    return flagged.select(
        *before,
        "order_id", "order_date", "customer_id", "product_name", "quantity", "unit_price",
        "country", "product_category", "invoice_status", *kept,
        as_bool_flag(q < 0).alias("is_return"),
        (p.isNull() | as_bool_flag(p <= 0)).alias("is_invalid_price"),
        F.col("customer_id").isNull().alias("is_missing_customer"),
        (F.col("original_order_date").isNotNull() & d.isNull()).alias("is_invalid_date"),
        cancelled.alias("is_cancelled"),
        dup,
        valid.alias("is_analysis_valid"),
        F.when(as_bool_flag((q > 0) & (p > 0)) & d.isNotNull() & ~dup, q * p).otherwise(F.lit(0.0))
        .alias("gross_revenue"),
        F.when(valid, q * p).otherwise(F.lit(0.0)).alias("net_revenue"),
    )


def cleaned_orders(prepared: DataFrame) -> DataFrame:
    """Typed view: missing category/country/status get explicit labels."""
    return prepared.select(
        F.col("order_id").cast("string").alias("order_id"),
        F.col("order_date").cast("timestamp").alias("order_date"),
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("product_name").cast("string").alias("product_name"),
        F.coalesce(F.col("product_category").cast("string"), F.lit("Uncategorized")).alias("product_category"),
        F.col("quantity").cast("double").alias("quantity"),
        F.col("unit_price").cast("double").alias("unit_price"),
        F.coalesce(F.col("country").cast("string"), F.lit("Unknown")).alias("country"),
        F.coalesce(F.col("invoice_status").cast("string"), F.lit("Unknown")).alias("invoice_status"),
        *[c for c in ("original_order_date", "copies") if c in prepared.columns],
        "is_return", "is_invalid_price", "is_missing_customer", "is_invalid_date", "is_cancelled",
        "is_duplicate_row", "is_analysis_valid",
        F.col("gross_revenue").cast("double").alias("gross_revenue"),
        F.col("net_revenue").cast("double").alias("net_revenue"),
    )


def _r2(c: Column) -> Column:
    return F.round(c, 2).cast("double")


def monthly_revenue(cleaned: DataFrame) -> DataFrame:
    month = F.date_trunc("month", "order_date").cast("date")
    not_dup = ~F.col("is_duplicate_row")
    per_order = (cleaned.filter(F.col("order_date").isNotNull())
                 .groupBy(month.alias("month"), "order_id")
                 .agg(F.sum(money("gross_revenue")).alias("g"),
                      F.sum(money("net_revenue")).alias("n"),
                      F.count_if(F.col("is_return") & not_dup).alias("r"),
                      F.max("is_analysis_valid").alias("v"),
                      F.max(F.col("is_cancelled") & not_dup).alias("c")))
    has_id = F.col("order_id").isNotNull()
    return (per_order.groupBy("month")
            .agg(_r2(F.sum("g")).alias("gross_revenue"),
                 _r2(F.sum("n")).alias("net_revenue"),
                 F.count_if(F.col("v") & has_id).alias("order_count"),
                 F.sum("r").cast("long").alias("return_rows"),
                 F.count_if(F.col("c") & has_id).alias("cancelled_orders")))


def product_performance(cleaned: DataFrame, limit: int = 100) -> DataFrame:
    return (cleaned.filter("is_analysis_valid")
            .groupBy("product_name", "product_category")
            .agg(_r2(F.sum(money("net_revenue"))).alias("net_revenue"),
                 _r2(F.sum(money("quantity"))).alias("quantity_sold"),
                 F.count_distinct("order_id").alias("order_count"))
            .orderBy(F.desc("net_revenue"), "product_name", "product_category")
            .limit(limit))


def country_performance(cleaned: DataFrame) -> DataFrame:
    return (cleaned.filter("is_analysis_valid")
            .groupBy("country")
            .agg(_r2(F.sum(money("net_revenue"))).alias("net_revenue"),
                 F.count_distinct("order_id").alias("order_count"),
                 F.count_distinct("customer_id").alias("customer_count")))


def _customer_rows(cleaned: DataFrame) -> DataFrame:
    cid = F.col("customer_id")
    return cleaned.filter(F.col("is_analysis_valid") & cid.isNotNull() & (F.trim(cid.cast("string")) != ""))


def rfm_base(cleaned: DataFrame) -> DataFrame:
    """Recency to (latest valid date + 1 day), distinct orders, net revenue > 0."""
    as_of = (cleaned.filter("is_analysis_valid")
             .agg((F.max("order_date") + F.expr("INTERVAL 1 DAY")).alias("as_of_date")))
    per_customer = (_customer_rows(cleaned).groupBy("customer_id")
                    .agg(F.max("order_date").alias("last_date"),
                         F.count_distinct("order_id").alias("frequency"),
                         _r2(F.sum(money("net_revenue"))).alias("monetary")))
    # as_of is one value, attached as a scalar subquery.
    return (per_customer
            .select("customer_id",
                    F.datediff(F.to_date(as_of.scalar()), F.to_date("last_date")).cast("long").alias("recency_days"),
                    "frequency", "monetary")
            .filter(F.col("monetary") > 0))


def _score(pct: Column) -> Column:
    return F.least(F.greatest(F.ceil(pct * F.lit(5.0)), F.lit(1)), F.lit(5)).cast("int")


def rfm_segments(base: DataFrame) -> DataFrame:
    """1-5 scores from average percentile ranks and the ordered segment rules.

    A score is a step function of its metric, so the ranks of the distinct values are only
    needed for the values at which it steps: twelve numbers, attached as one row. The
    customers themselves are neither ranked nor joined.
    """
    long = base.select(F.expr("stack(3, 'r', cast(recency_days as double), 'f', cast(frequency as double), "
                              "'m', cast(monetary as double)) as (metric, value)"))
    ranks = average_percent_rank(long, "value", "pct", group_cols=["metric"])
    up = F.when(F.col("metric") == "r", F.lit(1.0) - F.col("pct") + F.lit(1.0) / F.col("_n")).otherwise(F.col("pct"))
    steps = ranks.select("metric", "value", _score(up).alias("score"))
    cuts = steps.agg(*[
        (F.max if m == "r" else F.min)(F.when((F.col("metric") == m) & (F.col("score") >= k), F.col("value"))).alias(f"_{m}{k}")
        for m in "rfm" for k in range(2, 6)])

    def scored(column: str, m: str) -> Column:
        v = F.col(column).cast("double")
        hits = [as_bool_flag(v <= F.col(f"_{m}{k}") if m == "r" else v >= F.col(f"_{m}{k}")).cast("int") for k in range(2, 6)]
        return (F.lit(1) + hits[0] + hits[1] + hits[2] + hits[3]).cast("int").alias(f"{m}_score")

    scored = attach_row(base, cuts, "_cuts").select(
        "customer_id", "recency_days", "frequency", "monetary",
        scored("recency_days", "r"), scored("frequency", "f"), scored("monetary", "m"))
    rs, fs, ms = F.col("r_score"), F.col("f_score"), F.col("m_score")
    segment = (F.when((rs >= 4) & (fs >= 4) & (ms >= 4), "Champions")
               .when((fs >= 4) & (ms >= 3), "Loyal Customers")
               .when((rs >= 4) & (fs >= 2), "Potential Loyalists")
               .when((rs >= 4) & (fs <= 2), "New Customers")
               .when((rs <= 2) & (fs >= 3), "At Risk")
               .otherwise("Low Value"))
    return scored.select("customer_id", "recency_days", "frequency", "monetary", "r_score", "f_score", "m_score",
                         F.concat(rs.cast("string"), fs.cast("string"), ms.cast("string")).alias("rfm_score"),
                         segment.alias("segment"))


def segment_summary(segments: DataFrame) -> DataFrame:
    return (segments.groupBy("segment")
            .agg(F.count_distinct("customer_id").alias("customer_count"),
                 _r2(F.sum(money("monetary"))).alias("revenue")))


_TOTALS = ["g", "n", "qty", "ret", "rows_nd", "v", "c", "nd"]


def _per_order_and_customer(cleaned: DataFrame) -> DataFrame:
    """Totals and marks (0 or 1) per order and customer, in one array.

    Everything in :func:`kpis` starts here. One array, because aggregates that a branch does
    not use would be pruned from it, and branches that differ cannot share the exchange.
    """
    not_dup, one = ~F.col("is_duplicate_row"), F.lit(1)
    n_if = lambda c: F.count_if(c)
    mark = lambda c: F.max(F.when(c, one).otherwise(F.lit(0)))
    parts = [F.sum(money("gross_revenue")), F.sum(money("net_revenue")), F.sum(F.when(F.col("is_analysis_valid"), money("quantity"))),
             n_if(F.col("is_return") & not_dup), n_if(not_dup), mark(F.col("is_analysis_valid")), mark(F.col("is_cancelled") & not_dup), mark(not_dup)]
    return cleaned.groupBy("order_id", "customer_id").agg(F.array(*[F.coalesce(c, F.lit(0)).cast(T.DecimalType(38, 6)) for c in parts]).alias("a"))


def kpis(cleaned: DataFrame) -> DataFrame:
    """One-row KPI table; the source is evaluated once, the branches share its exchange."""
    part = _per_order_and_customer(cleaned)
    at = lambda name: F.element_at("a", _TOTALS.index(name) + 1)
    per_order = part.groupBy("order_id").agg(*[F.sum(at(c)).alias(c) for c in _TOTALS[:5]], *[F.max(at(c)).alias(c) for c in _TOTALS[5:]])
    marked = lambda c: F.count_if((F.col(c) > 0) & F.col("order_id").isNotNull())
    totals = per_order.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _TOTALS[:5]],
                           marked("v").alias("orders"), marked("c").alias("cancelled"), marked("nd").alias("orders_nd"))
    per_customer = part.groupBy("customer_id").agg(F.sum(at("n")).alias("n"), F.max(at("v")).alias("v"))
    # no filters: they would reach below the shared exchange
    known = F.coalesce((F.col("v") > 0) & (F.trim("customer_id") != ""), F.lit(False))
    customers = per_customer.agg(F.count_if(known).alias("customers"))
    monetary = F.when(known & (_r2(F.col("n")) > 0), _r2(F.col("n")))
    # Top-10 by monetary: per-partition top-k merged, bounded to 10 rows.
    top10 = (per_customer.select("customer_id", monetary.alias("monetary")).orderBy(F.desc_nulls_last("monetary"), "customer_id").limit(10)
             .agg(F.coalesce(F.sum(money("monetary")), F.lit(0)).alias("top10")))
    row = attach_row(attach_row(totals, customers, "_c"), top10, "_t")
    n = F.col("n").cast("double")
    orders = F.col("orders")
    return row.select(
        _r2(F.col("g")).alias("gross_revenue"),
        _r2(F.col("n")).alias("net_revenue"),
        orders.cast("double").alias("number_of_orders"),
        F.col("customers").cast("double").alias("number_of_customers"),
        F.when(orders > 0, F.round(F.col("n") / orders, 2)).otherwise(F.lit(0)).cast("double")
        .alias("average_order_value"),
        _r2(F.col("qty")).alias("total_quantity_sold"),
        F.when(F.col("rows_nd") > 0, F.round(F.col("ret").cast("decimal(38,10)") / F.col("rows_nd"), 4))
        .otherwise(F.lit(0)).cast("double").alias("return_rate"),
        F.when(F.col("orders_nd") > 0,
               F.round(F.col("cancelled").cast("decimal(38,10)") / F.col("orders_nd"), 4))
        .otherwise(F.lit(0)).cast("double").alias("cancelled_order_rate"),
        F.when(n != 0, F.round(F.col("top10").cast("decimal(38,10)") / F.col("n").cast("decimal(38,10)"), 4))
        .otherwise(F.lit(0)).cast("double").alias("share_revenue_top_10_customers"),
    )


def issue_summary(prepared: DataFrame) -> DataFrame:
    """Fixed list of (issue, row_count, severity, analysis_handling)."""
    flags = {"dup": "is_duplicate_row", "missing_customer": "is_missing_customer", "returns": "is_return", "bad_price": "is_invalid_price",
             "bad_date": "is_invalid_date", "cancelled": "is_cancelled"}
    counts = prepared.agg(*[flag_count(prepared, flag, {"is_invalid_date": "n_original_order_date"}).alias(name) for name, flag in flags.items()])
    # Issue labels, severities and handling notes.
    return counts.select(F.inline(F.array(
        _issue("Duplicate rows", "dup", "Medium",
               "First occurrence retained; repeated exact rows are excluded from KPI calculations."),
        _issue("Missing customer IDs", "missing_customer", "Medium",
               "Excluded from customer-level analytics, retained for sales totals."),
        _issue("Returns / negative quantities", "returns", "Business event",
               "Tracked as returns and excluded from net revenue KPIs."),
        _issue("Invalid unit prices", "bad_price", "High", "Excluded from revenue calculations."),
        _issue("Date parsing issues", "bad_date", "High",
               "Excluded from time-series analytics until dates are corrected."),
        _issue("Cancelled orders", "cancelled", "Business event", "Excluded from net revenue KPIs."),
    )))


def _issue(label: str, count_col: str, severity: str, handling: str) -> Column:
    return F.struct(F.lit(label).alias("issue"), F.col(count_col).cast("long").alias("row_count"),
                    F.lit(severity).alias("severity"), F.lit(handling).alias("analysis_handling"))


# ---- Interactive controls -----------------------------------------------------------

def controlled_orders(cleaned: DataFrame, start=None, end=None, values: dict[str, list] | None = None) -> DataFrame:
    """All cleaned rows inside the chosen dates and values (country, category, product)."""
    from sparkwright.operators.controls import filter_date_range, filter_values
    rows = filter_date_range(cleaned, "order_date", start, end) if start is not None or end is not None else cleaned
    return filter_values(rows, values or {})


def top_products(orders: DataFrame, measure: str = "net_revenue", n: int = 10) -> DataFrame:
    """Revenue (the chosen measure) and quantity per product; every row with a product counts, copies too."""
    pieces = money("quantity") * F.col("copies") if "copies" in orders.columns else money("quantity")
    agg = (orders.filter(F.col("product_name").isNotNull()).groupBy("product_name")
           .agg(_r2(F.sum(money(measure))).alias("revenue"), _r2(F.sum(pieces)).alias("quantity")))
    return agg.orderBy(F.desc("revenue"), "product_name").limit(n)


def top_customers(orders: DataFrame, measure: str = "net_revenue", n: int = 10) -> DataFrame:
    """Revenue (the chosen measure) and distinct orders per customer; every row with a customer counts."""
    agg = (orders.filter(F.col("customer_id").isNotNull()).groupBy("customer_id")
           .agg(_r2(F.sum(money(measure))).alias("revenue"), F.count_distinct("order_id").alias("order_count")))
    return agg.orderBy(F.desc("revenue"), "customer_id").limit(n)


def controlled_trend(orders: DataFrame, measure: str = "net_revenue") -> DataFrame:
    """Monthly sum of gross or net revenue."""
    from sparkwright.operators.controls import monthly_sum
    return monthly_sum(orders, "order_date", measure, "revenue")


def category_revenue(cleaned: DataFrame) -> DataFrame:
    """Net revenue of all valid rows by category."""
    return (cleaned.filter("is_analysis_valid").groupBy("product_category")
            .agg(_r2(F.sum(money("net_revenue"))).alias("net_revenue")))

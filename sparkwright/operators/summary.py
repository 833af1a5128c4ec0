"""Management summaries: (line_no, text) tables built from one-row facts.

Facts come from the KPI rows and from top/first/last rows picked with ``max_by`` /
``min_by`` aggregates, joined as one-row tables; the text is assembled with
``format_string`` / ``format_number`` in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.operators.common import attach_row


def _num(c: Column, digits: int) -> Column:
    """Thousands-separated number; rounded half-up first so formatting never sees a tie."""
    return F.format_number(F.round(c, digits), digits)


def _money(c: Column) -> Column:
    return F.concat(F.when(c < 0, F.lit("-$")).otherwise(F.lit("$")), _num(F.abs(c), 0))


def _pct(c: Column) -> Column:
    return F.format_string("%.1f%%", F.round(c * 100, 1))


def _top(key_value: tuple[str, str]) -> Column:
    """(key, value) of the row with the largest value; ties go to the smallest key."""
    key, value = key_value
    return F.min_by(F.struct(key, value), F.struct(-F.col(value), F.col(key)))


def _facts(base: DataFrame, *rows: DataFrame) -> DataFrame:
    for i, row in enumerate(rows):
        base = attach_row(base, row, f"_f{i}")
    return base


def _lines(facts: DataFrame, lines: list[Column]) -> DataFrame:
    arr = F.filter(F.array(*lines), lambda x: x.isNotNull())
    return facts.select(F.posexplode(arr).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def _issue_count(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count_if(F.col("row_count") > 0).alias("issue_categories"))


def retail(kpis: DataFrame, monthly: DataFrame, products: DataFrame, segments: DataFrame,
           issues: DataFrame) -> DataFrame:
    trend = monthly.filter(F.col("month").isNotNull()).agg(
        F.count(F.lit(1)).alias("months"),
        F.min_by("net_revenue", "month").alias("first_net"),
        F.max_by("net_revenue", "month").alias("last_net"))
    top_product = products.agg(_top(("product_name", "net_revenue")).alias("tp"))
    top_segment = segments.agg(_top(("segment", "revenue")).alias("ts"))
    facts = _facts(kpis, trend, top_product, top_segment, _issue_count(issues))
    change = (F.col("last_net") - F.col("first_net")) / F.abs(F.col("first_net"))
    trend_line = (F.when(F.col("months") < 2, F.lit(
        "Revenue trend cannot be assessed because fewer than two monthly periods are available."))
        .when(F.col("first_net") == 0, F.lit("Revenue trend improved from a zero baseline in the first available month."))
        .otherwise(F.format_string("Net revenue %s by %s from the first to the latest available month.",
                                   F.when(change >= 0, "increased").otherwise("decreased"), _pct(F.abs(change)))))
    share = F.col("share_revenue_top_10_customers")
    return _lines(facts, [
        F.lit("Management Summary"), F.lit(""),
        F.format_string("Net revenue is %s across %d valid orders.", _money(F.col("net_revenue")),
                        F.col("number_of_orders").cast("long")),
        trend_line,
        F.when(share >= 0.35, F.format_string(
            "The top 10 customers account for %s of net revenue, indicating meaningful customer concentration.",
            _pct(share))).otherwise(F.format_string(
                "The top 10 customers account for %s of net revenue, suggesting revenue is not overly concentrated.",
                _pct(share))),
        F.when(F.col("tp").isNotNull(), F.format_string("The strongest product is %s with %s in net revenue.",
                                                        F.col("tp.product_name"), _money(F.col("tp.net_revenue"))))
        .otherwise(F.lit("Product concentration cannot be assessed because no valid product revenue was available.")),
        F.when(F.col("ts").isNotNull(), F.format_string(
            "The largest revenue customer segment is %s with %s in net revenue.", F.col("ts.segment"),
            _money(F.col("ts.revenue")))).otherwise(F.lit(
                "Customer segments could not be calculated because customer-level revenue was unavailable.")),
        F.when(F.col("issue_categories") > 0, F.format_string(
            "Data quality review found %d issue categories requiring attention before production reporting.",
            F.col("issue_categories"))).otherwise(F.lit("The current quality checks did not find major issues.")),
        F.format_string("Return rate is %s; cancelled order rate is %s.", _pct(F.col("return_rate")),
                        _pct(F.col("cancelled_order_rate"))),
    ])


def manufacturing(kpis: DataFrame, machines: DataFrame, issues: DataFrame) -> DataFrame:
    worst = machines.agg(_top(("machine_id", "downtime_minutes")).alias("wm"))
    facts = _facts(kpis, worst, _issue_count(issues))
    oee = F.col("simplified_oee_approximation")
    return _lines(facts, [
        F.lit("Manufacturing Management Summary"), F.lit(""),
        F.format_string("Total valid output is %s units with a scrap rate of %s.",
                        _num(F.col("total_output"), 0), _pct(F.coalesce(F.col("scrap_rate"), F.lit(0.0)))),
        F.format_string("Total downtime is %s minutes, averaging %s minutes per machine.",
                        _num(F.col("total_downtime_minutes"), 0),
                        _num(F.col("average_downtime_per_machine"), 1)),
        F.format_string("Production attainment is %s where planned output is available.",
                        _pct(F.coalesce(F.col("production_attainment"), F.lit(0.0)))),
        F.format_string("Quality rate approximation is %s.",
                        _pct(F.coalesce(F.col("quality_rate_approximation"), F.lit(0.0)))),
        F.when(oee.isNotNull(), F.format_string(
            "Simplified OEE approximation is %s; this is not a certified OEE standard.", _pct(oee))),
        F.when(F.col("wm").isNotNull(), F.format_string(
            "The highest downtime machine is %s with %s downtime minutes.", F.col("wm.machine_id"),
            _num(F.col("wm.downtime_minutes"), 0))).otherwise(F.lit(
                "Machine-level downtime cannot be assessed because no valid machine performance rows were available.")),
        F.when(F.col("issue_categories") > 0, F.format_string(
            "Data quality review found %d issue categories requiring attention.", F.col("issue_categories")))
        .otherwise(F.lit("The current quality checks did not find major manufacturing data issues.")),
    ])


def logistics(kpis: DataFrame, carriers: DataFrame, issues: DataFrame) -> DataFrame:
    best = carriers.agg(_top(("carrier", "on_time_rate")).alias("bc"))
    facts = _facts(kpis, best, _issue_count(issues))
    return _lines(facts, [
        F.lit("Logistics Management Summary"), F.lit(""),
        F.format_string("The active dataset contains %s valid shipments.", _num(F.col("shipment_count"), 0)),
        F.format_string("Average lead time is %s days and on-time delivery rate is %s.",
                        _num(F.col("average_lead_time_days"), 1), _pct(F.col("on_time_delivery_rate"))),
        F.format_string("Delayed shipments total %s, with an average delay of %s days.",
                        _num(F.col("delayed_shipments"), 0), _num(F.col("average_delay_days"), 1)),
        F.format_string("Total mapped shipping cost is %s.", _money(F.col("total_shipping_cost"))),
        F.when(F.col("bc").isNotNull(), F.format_string(
            "The strongest carrier by on-time rate is %s at %s.", F.col("bc.carrier"), _pct(F.col("bc.on_time_rate"))))
        .otherwise(F.lit("Carrier performance cannot be assessed because no usable carrier values were available.")),
        F.when(F.col("issue_categories") > 0, F.format_string(
            "Data quality review found %d logistics issue categories requiring attention.", F.col("issue_categories")))
        .otherwise(F.lit("The current quality checks did not find major logistics data issues.")),
    ])


def finance(kpis: DataFrame, categories: DataFrame, issues: DataFrame) -> DataFrame:
    top = categories.agg(_top(("category", "amount")).alias("tc"))
    facts = _facts(kpis, top, _issue_count(issues))
    return _lines(facts, [
        F.lit("Finance Management Summary"), F.lit(""),
        F.format_string("Total revenue is %s and total cost is %s.", _money(F.col("total_revenue")),
                        _money(F.col("total_cost"))),
        F.format_string("Net result is %s with a margin of %s.", _money(F.col("net_result")), _pct(F.col("margin"))),
        F.format_string("The dataset includes %s valid finance transactions.",
                        _num(F.col("transaction_count"), 0)),
        F.format_string("Budget variance is %s where budget and actual fields are available.",
                        _money(F.col("budget_variance"))),
        F.when(F.col("tc").isNotNull(), F.format_string("The largest mapped category is %s with %s.",
                                                        F.col("tc.category"), _money(F.col("tc.amount"))))
        .otherwise(F.lit("Category-level performance cannot be assessed because no valid categories were available.")),
        F.when(F.col("issue_categories") > 0, F.format_string(
            "Data quality review found %d finance issue categories requiring attention.", F.col("issue_categories")))
        .otherwise(F.lit("The current quality checks did not find major finance data issues.")),
    ])


def generic(score_row: DataFrame, n_columns: int, rows_used: DataFrame | None = None,
            measures: list[str] | None = None) -> DataFrame:
    facts = score_row if rows_used is None else _facts(score_row, rows_used)
    lines = [
        F.lit("Generic Data Summary"), F.lit(""),
        F.format_string("The active dataset has %s rows and %s columns.", _num(F.col("row_count"), 0),
                        _num(F.lit(n_columns), 0)),
        F.format_string("Data quality score is %.1f/100.", F.round(F.col("overall_score"), 1)),
        F.format_string("Missing values total %s cells and duplicate rows total %s.",
                        _num(F.col("missing_cells"), 0), _num(F.col("duplicate_rows"), 0)),
    ]
    if rows_used is not None:
        lines.append(F.format_string("The latest generic analytics result used %s rows and measures: %s.",
                                     _num(F.col("rows_used"), 0), F.lit(", ".join(measures or []))))
    # Next-action lines.
    lines += [F.lit(""), F.lit("Recommended next actions:"),
              F.lit("- Review high-missing columns in Data Profile or Data Quality."),
              F.lit("- Use Data Preparation for logged cleaning steps."),
              F.lit("- Use Generic Analytics for exploratory cuts."),
              F.lit("- Map a domain template only when the dataset has clear business fields.")]
    return _lines(facts, lines)

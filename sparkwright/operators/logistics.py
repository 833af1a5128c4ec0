"""Logistics template: shipment timing, on-time and cost tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.functions import as_bool_flag, clean_text, money, parse_dates, to_number
from sparkwright.operators.common import apply_mapping, distinct_records, flag_duplicates
from sparkwright.operators.manufacturing import issue_table
from sparkwright.operators.ranking import exact_quantile
from sparkwright.sources.sinks import stage_table
from sparkwright.templates import LOGISTICS_OPTIONAL, LOGISTICS_REQUIRED

FIELDS = LOGISTICS_REQUIRED + LOGISTICS_OPTIONAL
TEXT_FIELDS = ["shipment_id", "carrier", "origin", "destination", "delivery_status"]
DATE_FIELDS = ["order_date", "delivery_date", "planned_delivery_date"]
# Fixed value: shipping-cost quantile above which a row is an outlier.
HIGH_COST_QUANTILE = 0.98
_DAY_MICROS = 86_400_000_000


def _dtype(raw: DataFrame, mapping: dict, field: str) -> T.DataType:
    src = mapping.get(field)
    return raw.schema[src].dataType if src and src in raw.columns else T.StringType()


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole days elapsed, floored like a timedelta's ``days`` (-1.5 days -> -2)."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(_DAY_MICROS)).cast("long")


def _typed(raw: DataFrame, mapping: dict[str, str | None], order_cols: list[str]) -> DataFrame:
    base = apply_mapping(raw, mapping, FIELDS, keep=order_cols)
    return base.select(
        *[clean_text(f).alias(f) for f in TEXT_FIELDS],
        *[F.col(f).cast("string").alias(f"original_{f}") for f in DATE_FIELDS],
        *[parse_dates(f, _dtype(raw, mapping, f)).alias(f) for f in DATE_FIELDS],
        to_number("shipping_cost", _dtype(raw, mapping, "shipping_cost")).alias("shipping_cost"),
        *order_cols,
    )


def prepare(raw: DataFrame, mapping: dict[str, str | None], order_cols: list[str]) -> DataFrame:
    """Every row with its flags; rows are identified by ``order_cols``. The typed rows are written once, as the flag reads them twice."""
    typed = stage_table(_typed(raw, mapping, order_cols), "logistics")
    flagged = flag_duplicates(typed, FIELDS, order_cols)
    return _flagged(flagged, typed, None, [*order_cols, *FIELDS, *[f"original_{f}" for f in DATE_FIELDS]])


def records(raw: DataFrame, mapping: dict[str, str | None], staged: bool = False) -> DataFrame:
    """Distinct records with their flags and ``copies``: what the KPI tables are made of.

    ``staged`` writes them once, for tables that read them several times (the cost quantile does too).
    """
    originals = [f"original_{f}" for f in DATE_FIELDS]
    found = distinct_records(_typed(raw, mapping, []), FIELDS, originals)
    found = stage_table(found, "records") if staged else found
    found = found.withColumns({c: F.when(F.col(f"n_{c}") > 0, F.lit("")) for c in originals})
    return _flagged(found, found, "copies", [*FIELDS, "copies", *[f"n_{c}" for c in originals]])


def _flagged(flagged: DataFrame, costs: DataFrame, weight: str | None, kept: list[str]) -> DataFrame:
    # The 98th percentile is one value, attached as a scalar subquery; unused, it is not computed.
    p98 = exact_quantile(costs, "shipping_cost", HIGH_COST_QUANTILE, "_p98", weight_col=weight).scalar()
    delay = elapsed_days(F.col("delivery_date"), F.col("planned_delivery_date"))
    return flagged.select(
        *kept, "is_duplicate_row",
        F.col("carrier").isNull().alias("is_missing_carrier"),
        F.col("delivery_date").isNull().alias("is_missing_delivery_date"),
        (F.col("original_order_date").isNotNull() & F.col("order_date").isNull()).alias("is_invalid_order_date"),
        (F.col("original_planned_delivery_date").isNotNull() & F.col("planned_delivery_date").isNull())
        .alias("is_invalid_planned_delivery_date"),
        elapsed_days(F.col("delivery_date"), F.col("order_date")).alias("lead_time_days"),
        delay.alias("delay_days"),
        as_bool_flag(delay <= 0).alias("is_on_time"),
        as_bool_flag(F.col("shipping_cost") > p98).alias("is_high_shipping_cost"),
        (F.col("shipment_id").isNotNull() & F.col("order_date").isNotNull() & F.col("delivery_date").isNotNull()
         & F.col("planned_delivery_date").isNotNull() & ~F.col("is_duplicate_row")).alias("is_analysis_valid"),
    )


def analysis_rows(prepared: DataFrame) -> DataFrame:
    return prepared.filter("is_analysis_valid")


def _avg2(c: Column, scale: int = 2) -> Column:
    return F.round(F.avg(c), scale)


def _positive_delay_avg(scale: int) -> Column:
    d = F.col("delay_days")
    return F.coalesce(F.round(F.avg(F.when(d > 0, d)), scale), F.lit(0.0))


def kpis(rows: DataFrame) -> DataFrame:
    t = rows.agg(
        F.count_distinct("shipment_id").alias("shipments"),
        F.avg("lead_time_days").alias("lead"),
        F.avg(F.col("is_on_time").cast("double")).alias("on_time"),
        F.count_if(F.col("delay_days") > 0).alias("delayed"),
        F.avg(F.when(F.col("delay_days") > 0, F.col("delay_days"))).alias("delay"),
        F.coalesce(F.sum(money("shipping_cost")), F.lit(0)).alias("cost"),
    )
    s = F.col("shipments")
    return t.select(
        s.cast("double").alias("shipment_count"),
        F.coalesce(F.round("lead", 2), F.lit(0.0)).alias("average_lead_time_days"),
        F.coalesce(F.round("on_time", 4), F.lit(0.0)).alias("on_time_delivery_rate"),
        F.col("delayed").cast("double").alias("delayed_shipments"),
        F.when(F.col("delayed") > 0, F.round("delay", 2)).otherwise(F.lit(0.0)).alias("average_delay_days"),
        F.round("cost", 2).cast("double").alias("total_shipping_cost"),
        F.when(s > 0, F.round(F.col("cost").cast("double") / s, 2)).otherwise(F.lit(0.0))
        .alias("average_cost_per_shipment"),
    )


def _month(c: str) -> Column:
    return F.date_trunc("month", c)


def shipments_over_time(rows: DataFrame) -> DataFrame:
    return rows.groupBy(_month("order_date").alias("order_month"))\
        .agg(F.count_distinct("shipment_id").alias("shipment_count"))


def lead_time_over_time(rows: DataFrame) -> DataFrame:
    return rows.groupBy(_month("order_date").alias("order_month"))\
        .agg(_avg2(F.col("lead_time_days")).alias("average_lead_time_days"))


def status_summary(rows: DataFrame) -> DataFrame:
    result = F.when(F.col("is_on_time"), "On time").otherwise("Delayed")
    return rows.groupBy(result.alias("delivery_result")).agg(F.count_distinct("shipment_id").alias("shipments"))


def carrier_performance(rows: DataFrame) -> DataFrame:
    return (rows.filter(F.col("carrier").isNotNull()).groupBy("carrier")
            .agg(F.count_distinct("shipment_id").alias("shipment_count"),
                 _avg2(F.col("lead_time_days"), 4).alias("average_lead_time_days"),
                 _positive_delay_avg(4).alias("average_delay_days"),
                 F.round(F.avg(F.col("is_on_time").cast("double")), 4).alias("on_time_rate"),
                 F.round(F.coalesce(F.sum(money("shipping_cost")), F.lit(0)), 4).cast("double")
                 .alias("total_shipping_cost")))


def destination_performance(rows: DataFrame) -> DataFrame:
    return (rows.filter(F.col("destination").isNotNull()).groupBy("destination")
            .agg(F.count_distinct("shipment_id").alias("shipment_count"),
                 F.count_if(F.col("delay_days") > 0).alias("delayed_shipments"),
                 _positive_delay_avg(2).alias("average_delay_days")))


def delayed_shipments(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("delay_days") > 0).orderBy(F.desc("delay_days"))


def controlled_trend(rows: DataFrame, date_field: str = "order_date", measure: str = "shipment_count") -> DataFrame:
    g = rows.groupBy(_month(date_field).alias("period"))
    if measure == "shipment_count":
        t = g.agg(F.count_distinct("shipment_id").cast("double").alias("value"))
    elif measure == "average_lead_time_days":
        t = g.agg(F.avg("lead_time_days").alias("value"))
    elif measure == "delayed_shipments":
        t = g.agg(F.count_if(F.col("delay_days") > 0).cast("double").alias("value"))
    else:
        t = g.agg(F.round(F.sum(money("shipping_cost")), 2).cast("double").alias("value"))
    return t.select("period", F.coalesce(F.round("value", 4), F.lit(0.0)).alias("value"))


def ranking(rows: DataFrame, key: str, measure: str = "shipment_count", n: int = 10) -> DataFrame:
    table = (rows.filter(F.col(key).isNotNull()).groupBy(key)
             .agg(F.count_distinct("shipment_id").alias("shipment_count"),
                  F.coalesce(F.round(F.avg("lead_time_days"), 4), F.lit(0.0)).alias("average_lead_time_days"),
                  F.count_if(F.col("delay_days") > 0).alias("delayed_shipments"),
                  F.round(F.coalesce(F.sum(money("shipping_cost")), F.lit(0)), 2).cast("double")
                  .alias("total_shipping_cost")))
    return table.orderBy(F.desc(measure), key).limit(n)


def issue_summary(prepared: DataFrame) -> DataFrame:
    # Issue labels, severities and handling notes.
    return issue_table(prepared, [
        ("Duplicate rows", "is_duplicate_row", "Medium", "Duplicate shipments are excluded from KPI calculations."),
        ("Missing carrier", "is_missing_carrier", "Low",
         "Rows remain in core KPIs but are not useful for carrier cuts."),
        ("Missing delivery dates", "is_missing_delivery_date", "High",
         "Rows are excluded from lead-time and on-time metrics."),
        ("Order date parsing issues", "is_invalid_order_date", "High",
         "Rows are excluded from time-based shipment analytics."),
        ("Planned delivery date parsing issues", "is_invalid_planned_delivery_date", "High",
         "Rows are excluded from delay metrics."),
        ("High shipping cost outliers", "is_high_shipping_cost", "Business review",
         "Rows are retained but should be reviewed."),
    ], {"is_invalid_order_date": "n_original_order_date", "is_invalid_planned_delivery_date": "n_original_planned_delivery_date"})

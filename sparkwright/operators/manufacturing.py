"""Manufacturing template: production flags, KPIs, machine/line/shift and daily tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.functions import as_bool_flag, clean_text, exact, parse_dates, to_number
from sparkwright.operators.common import apply_mapping, distinct_records, flag_duplicates
from sparkwright.sources.sinks import stage_table
from sparkwright.templates import MANUFACTURING_OPTIONAL, MANUFACTURING_REQUIRED

FIELDS = MANUFACTURING_REQUIRED + MANUFACTURING_OPTIONAL
DUPLICATE_FIELDS = ["timestamp", "machine_id", "line", "shift", "product", "planned_output", "actual_output",
                    "scrap_count", "downtime_minutes", "runtime_minutes", "quality_status"]
TEXT_FIELDS = ["machine_id", "line", "shift", "product", "quality_status"]
NUMERIC_FIELDS = ["actual_output", "scrap_count", "downtime_minutes", "planned_output", "runtime_minutes"]
# Fixed value: scrap share above which a row is a high-scrap observation.
HIGH_SCRAP_SHARE = 0.15


def _dtype(raw: DataFrame, mapping: dict, field: str) -> T.DataType:
    src = mapping.get(field)
    return raw.schema[src].dataType if src and src in raw.columns else T.StringType()


def sum2(c: str | Column) -> Column:
    """Exact sum rounded to 2 places, as double."""
    return F.round(F.sum(exact(c)), 2).cast("double")


def rate(num: Column, den: Column, scale: int = 4) -> Column:
    """Rounded ratio of two sums; null when the denominator is not positive."""
    return F.when(den > 0, F.round(num.cast("double") / den.cast("double"), scale))


def _typed(raw: DataFrame, mapping: dict[str, str | None], order_cols: list[str]) -> DataFrame:
    base = apply_mapping(raw, mapping, FIELDS, keep=order_cols)
    return base.select(
        F.col("timestamp").cast("string").alias("original_timestamp"),
        parse_dates("timestamp", _dtype(raw, mapping, "timestamp")).alias("timestamp"),
        *[clean_text(f).alias(f) for f in TEXT_FIELDS],
        *[to_number(f, _dtype(raw, mapping, f)).alias(f) for f in NUMERIC_FIELDS],
        *order_cols,
    )


def prepare(raw: DataFrame, mapping: dict[str, str | None], order_cols: list[str]) -> DataFrame:
    """Every row with its flags; rows are identified by ``order_cols``. The typed rows are written once, as the flag reads them twice."""
    flagged = flag_duplicates(stage_table(_typed(raw, mapping, order_cols), "manufacturing"), DUPLICATE_FIELDS, order_cols)
    return _flagged(flagged, [*order_cols, *FIELDS, "original_timestamp"])


def records(raw: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Distinct records with their flags and ``copies``: what the KPI tables are made of."""
    found = distinct_records(_typed(raw, mapping, []), list(dict.fromkeys([*DUPLICATE_FIELDS, *FIELDS])), ["original_timestamp"])
    found = found.withColumn("original_timestamp", F.when(F.col("n_original_timestamp") > 0, F.lit("")))
    return _flagged(found, [*FIELDS, "copies", "n_original_timestamp"])


def _flagged(flagged: DataFrame, kept: list[str]) -> DataFrame:
    actual, scrap, down = F.col("actual_output"), F.col("scrap_count"), F.col("downtime_minutes")
    planned = F.col("planned_output")
    invalid_output = actual.isNull() | as_bool_flag(actual < 0)
    invalid_scrap = scrap.isNull() | as_bool_flag(scrap < 0)
    invalid_down = down.isNull() | as_bool_flag(down < 0)
    return flagged.select(
        *kept, "is_duplicate_row",
        F.col("machine_id").isNull().alias("is_missing_machine"),
        (F.col("original_timestamp").isNotNull() & F.col("timestamp").isNull()).alias("is_invalid_timestamp"),
        invalid_output.alias("is_invalid_output"),
        invalid_scrap.alias("is_invalid_scrap"),
        as_bool_flag((actual > 0) & (F.try_divide(scrap, actual) > HIGH_SCRAP_SHARE)).alias("is_high_scrap"),
        invalid_down.alias("is_invalid_downtime"),
        as_bool_flag(planned.isNotNull() & (planned <= 0)).alias("is_zero_planned_output"),
        F.col("shift").isNull().alias("is_missing_shift"),
        (F.col("timestamp").isNotNull() & F.col("machine_id").isNotNull() & ~invalid_output & ~invalid_scrap
         & ~invalid_down & ~F.col("is_duplicate_row")).alias("is_analysis_valid"),
    )


def analysis_rows(prepared: DataFrame) -> DataFrame:
    return prepared.filter("is_analysis_valid")


def ratio(part: str, whole: str) -> Column:
    """Quotient to four places, halves up on ten decimal places."""
    value = F.col(part).cast("double") / F.col(whole).cast("double")
    return F.round(value.cast(T.DecimalType(28, 10)), 4).cast("double")


def kpis(rows: DataFrame) -> DataFrame:
    planned_ok = F.col("planned_output").isNotNull() & (F.col("planned_output") > 0)
    runtime_ok = F.col("runtime_minutes").isNotNull() & (F.col("runtime_minutes") >= 0)
    t = rows.agg(
        F.coalesce(F.sum(exact("actual_output")), F.lit(0)).alias("out"),
        F.coalesce(F.sum(exact("scrap_count")), F.lit(0)).alias("scrap"),
        F.coalesce(F.sum(exact("downtime_minutes")), F.lit(0)).alias("down"),
        F.count_distinct("machine_id").alias("machines"),
        F.coalesce(F.sum(F.when(planned_ok, exact("planned_output"))), F.lit(0)).alias("plan"),
        F.coalesce(F.sum(F.when(planned_ok, exact("actual_output"))), F.lit(0)).alias("plan_out"),
        F.coalesce(F.sum(F.when(runtime_ok, exact("runtime_minutes"))), F.lit(0)).alias("run"),
        F.coalesce(F.sum(F.when(runtime_ok, exact("downtime_minutes"))), F.lit(0)).alias("run_down"),
    )
    out, scrap, down = F.col("out"), F.col("scrap"), F.col("down")
    att = F.when(F.col("plan") != 0, rate(F.col("plan_out"), F.col("plan")))
    avail = F.when(F.col("run") + F.col("run_down") > 0,
                   rate(F.col("run"), F.col("run") + F.col("run_down")))
    quality = rate(out - scrap, out)
    dec = T.DecimalType(12, 4)
    oee = F.round(att.cast(dec) * avail.cast(dec) * quality.cast(dec), 4).cast("double")
    return t.select(
        F.round(out, 2).cast("double").alias("total_output"),
        F.round(scrap, 2).cast("double").alias("total_scrap"),
        rate(scrap, out).alias("scrap_rate"),
        F.round(down, 2).cast("double").alias("total_downtime_minutes"),
        F.when(F.col("machines") > 0, F.round(down.cast("double") / F.col("machines"), 2))
        .otherwise(F.lit(0.0)).alias("average_downtime_per_machine"),
        att.alias("production_attainment"),
        avail.alias("availability_approximation"),
        quality.alias("quality_rate_approximation"),
        oee.alias("simplified_oee_approximation"),
    )


def machine_performance(rows: DataFrame) -> DataFrame:
    agg = rows.groupBy("machine_id").agg(
        F.sum(exact("actual_output")).alias("o"), F.sum(exact("scrap_count")).alias("s"),
        F.sum(exact("downtime_minutes")).alias("d"), F.count(F.lit(1)).alias("record_count"))
    return agg.select(
        "machine_id",
        F.round("o", 4).cast("double").alias("total_output"),
        F.round("s", 4).cast("double").alias("total_scrap"),
        F.coalesce(rate(F.col("s"), F.col("o")), F.lit(0.0)).alias("scrap_rate"),
        F.round("d", 4).cast("double").alias("downtime_minutes"),
        "record_count",
    ).orderBy(F.desc("downtime_minutes"), F.desc("scrap_rate"), "machine_id")


def over_time(rows: DataFrame, value: str, out: str | None = None) -> DataFrame:
    return (rows.groupBy(F.date_trunc("day", "timestamp").alias("period"))
            .agg(sum2(value).alias(out or value)))


def by_optional(rows: DataFrame, column: str) -> DataFrame:
    return (rows.filter(F.col(column).isNotNull()).groupBy(column)
            .agg(sum2("actual_output").alias("actual_output")))


def controlled_trend(rows: DataFrame, measure: str = "scrap_rate") -> DataFrame:
    """Daily scrap rate, attainment or plain sum; undefined ratios become 0."""
    g = rows.groupBy(F.date_trunc("day", "timestamp").alias("period"))
    if measure == "scrap_rate":
        t = g.agg(F.sum(exact("actual_output")).alias("o"), F.sum(exact("scrap_count")).alias("s"))
        value = F.when(F.col("o") != 0, ratio("s", "o"))
    elif measure == "production_attainment":
        t = g.agg(F.sum(exact("actual_output")).alias("o"), F.sum(exact("planned_output")).alias("p"))
        value = F.when(F.col("p") != 0, ratio("o", "p"))
    else:
        t = g.agg(F.sum(exact(measure)).alias("v"))
        value = F.round(F.col("v"), 2).cast("double")
    return t.select("period", F.coalesce(value, F.lit(0.0)).alias("value"))


def machine_ranking(rows: DataFrame, measure: str = "downtime_minutes", n: int = 10) -> DataFrame:
    agg = rows.groupBy("machine_id").agg(
        F.coalesce(F.sum(exact("actual_output")), F.lit(0)).alias("o"),
        F.coalesce(F.sum(exact("scrap_count")), F.lit(0)).alias("s"),
        F.coalesce(F.sum(exact("downtime_minutes")), F.lit(0)).alias("d"),
        F.coalesce(F.sum(exact("planned_output")), F.lit(0)).alias("p"))
    table = agg.select(
        "machine_id",
        F.round("o", 2).cast("double").alias("actual_output"),
        F.round("s", 2).cast("double").alias("scrap_count"),
        F.round("d", 2).cast("double").alias("downtime_minutes"),
        F.round("p", 2).cast("double").alias("planned_output"),
        F.coalesce(F.when(F.col("o") != 0, ratio("s", "o")),
                   F.lit(0.0)).alias("scrap_rate"),
        F.coalesce(F.when(F.col("p") != 0, ratio("o", "p")),
                   F.lit(0.0)).alias("production_attainment"))
    return table.orderBy(F.desc(measure), "machine_id").limit(n)


def issue_summary(prepared: DataFrame) -> DataFrame:
    # Issue labels, severities and handling notes.
    checks = [
        ("Duplicate rows", "is_duplicate_row", "Medium",
         "Duplicate production records are excluded from KPI calculations."),
        ("Missing machine IDs", "is_missing_machine", "High",
         "Rows cannot be attributed to a machine and are excluded from KPI calculations."),
        ("Timestamp parsing issues", "is_invalid_timestamp", "High",
         "Rows are excluded from time-series analytics until timestamps are corrected."),
        ("Invalid output values", "is_invalid_output", "High", "Rows are excluded from output KPIs."),
        ("Invalid scrap values", "is_invalid_scrap", "High", "Rows are excluded from scrap KPIs."),
        ("High scrap observations", "is_high_scrap", "Business review",
         "Rows are retained but should be investigated."),
        ("Invalid downtime values", "is_invalid_downtime", "High", "Rows are excluded from downtime KPIs."),
        ("Zero or missing planned output", "is_zero_planned_output", "Medium",
         "Rows are excluded from attainment calculations."),
        ("Missing shift values", "is_missing_shift", "Low",
         "Rows remain in core KPIs but are not useful for shift cuts."),
    ]
    return issue_table(prepared, checks, {"is_invalid_timestamp": "n_original_timestamp"})


def flag_count(rows: DataFrame, flag: str, weights: dict[str, str] | None = None) -> Column:
    """Rows with a flag; distinct records count as their copies, or as what ``weights`` names for the flag."""
    if "copies" not in rows.columns:
        return F.count_if(flag)
    if flag == "is_duplicate_row":
        return F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))
    return F.coalesce(F.sum(F.when(F.col(flag), F.col((weights or {}).get(flag, "copies")))), F.lit(0))


def issue_table(prepared: DataFrame, checks: list[tuple[str, str, str, str]], weights: dict[str, str] | None = None) -> DataFrame:
    """One scan: count every flag, then one row per check."""
    counts = prepared.agg(*[flag_count(prepared, flag, weights).alias(f"_c{i}") for i, (_, flag, _, _) in enumerate(checks)])
    rows = [F.struct(F.lit(label).alias("issue"), F.col(f"_c{i}").cast("long").alias("row_count"),
                     F.lit(sev).alias("severity"), F.lit(note).alias("analysis_handling"))
            for i, (label, _, sev, note) in enumerate(checks)]
    return counts.select(F.inline(F.array(*rows)))

"""Explainable quality: weighted score, template rules, rule severity and issue rows.

Rules are (name, severity, boolean Column) triples over the mapped source columns. All
rule counts of a template come from one aggregate; issue rows come from one scan that
explodes the violated rules of each row (instead of one pass per rule).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions import as_bool_flag, parse_dates, to_number
from sparkwright.operators.common import attach_row
from sparkwright.templates import COST_TYPES, REVENUE_TYPES, RULE_TEMPLATE_LABELS, get_template

SEVERITIES = ["critical", "warning", "info"]
# Score weights per dimension.
WEIGHTS = {"missing_values": 0.25, "duplicate_rows": 0.15, "invalid_numeric_values": 0.2,
           "schema_completeness": 0.25, "date_parsing": 0.15}


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    fields: tuple[str, ...]
    mask: Callable[..., Column]
    explanation: str
    fix: str


class _Src:
    """Column views of mapped fields for one source table."""

    def __init__(self, df: DataFrame, mapping: dict[str, str | None]):
        self.df, self.mapping = df, mapping

    def has(self, *fields: str) -> bool:
        return all(self.mapping.get(f) and self.mapping[f] in self.df.columns for f in fields)

    def raw(self, f: str) -> Column:
        return F.col(f"`{self.mapping[f]}`")

    def num(self, f: str) -> Column:
        return to_number(self.raw(f), self.df.schema[self.mapping[f]].dataType)

    def date(self, f: str) -> Column:
        return parse_dates(self.raw(f), self.df.schema[self.mapping[f]].dataType)

    def blank(self, f: str) -> Column:
        return self.raw(f).isNull() | (F.trim(self.raw(f).cast("string")) == "")


def _interpretable(s: _Src) -> Column:
    norm = F.lower(F.trim(s.raw("type").cast("string")))
    return ~F.coalesce(norm.isin(REVENUE_TYPES + COST_TYPES), F.lit(False))


# Rule names, severities, explanations and fixes per template.
RULES: dict[str, list[Rule]] = {
    "sales_retail": [
        Rule("order_date missing or invalid", "critical", ("order_date",), lambda s: s.date("order_date").isNull(),
             "Orders without usable dates cannot support trend analysis.", "Standardize or fill valid order dates."),
        Rule("quantity equals zero", "warning", ("quantity",), lambda s: s.num("quantity") == 0,
             "Zero-quantity rows do not contribute meaningful sales volume.",
             "Review whether these rows are corrections, cancelled lines, or data-entry issues."),
        Rule("negative quantity potential return", "info", ("quantity",), lambda s: s.num("quantity") < 0,
             "Negative quantities may represent returns.", "Confirm return handling before interpreting net sales."),
        Rule("unit_price <= 0", "critical", ("unit_price",), lambda s: s.num("unit_price") <= 0,
             "Invalid prices distort revenue KPIs.",
             "Correct prices or exclude invalid transaction lines with an audit trail."),
        Rule("missing customer_id", "warning", ("customer_id",), lambda s: s.blank("customer_id"),
             "Missing customers weaken customer and RFM analysis.",
             "Backfill customer IDs where possible or exclude rows from customer-level KPIs."),
        Rule("missing product_name", "warning", ("product_name",), lambda s: s.blank("product_name"),
             "Missing products weaken product performance reporting.",
             "Fill or correct product descriptions before product analysis."),
    ],
    "manufacturing": [
        Rule("actual_output < 0", "critical", ("actual_output",), lambda s: s.num("actual_output") < 0,
             "Negative output is not valid for production KPIs.", "Correct production output values."),
        Rule("scrap_count > actual_output", "critical", ("scrap_count", "actual_output"),
             lambda s: s.num("scrap_count") > s.num("actual_output"),
             "Scrap greater than output indicates a likely data issue.", "Validate scrap and output capture logic."),
        Rule("downtime_minutes < 0", "critical", ("downtime_minutes",), lambda s: s.num("downtime_minutes") < 0,
             "Negative downtime is not meaningful.", "Correct downtime records before downtime KPIs."),
        Rule("planned_output <= 0", "warning", ("planned_output",), lambda s: s.num("planned_output") <= 0,
             "Zero or negative planned output prevents attainment analysis.",
             "Fill valid planned output or exclude rows from attainment metrics."),
        Rule("missing machine_id", "critical", ("machine_id",), lambda s: s.blank("machine_id"),
             "Rows without machine IDs cannot support machine performance reporting.",
             "Backfill or correct machine identifiers."),
        Rule("missing timestamp", "critical", ("timestamp",), lambda s: s.date("timestamp").isNull(),
             "Rows without timestamps cannot support production trends.", "Standardize production timestamps."),
    ],
    "logistics": [
        Rule("delivery_date before order_date", "critical", ("order_date", "delivery_date"),
             lambda s: s.date("delivery_date") < s.date("order_date"),
             "Delivery before order date is logically inconsistent.", "Correct order or delivery date values."),
        Rule("missing delivery_date", "critical", ("delivery_date",), lambda s: s.date("delivery_date").isNull(),
             "Missing delivery dates prevent lead-time and on-time calculations.",
             "Fill delivery dates or separate open shipments from delivered shipments."),
        Rule("planned_delivery_date missing", "warning", ("planned_delivery_date",),
             lambda s: s.date("planned_delivery_date").isNull(),
             "Missing planned delivery dates prevent delay calculations.",
             "Backfill promised delivery dates where available."),
        Rule("shipping_cost < 0", "critical", ("shipping_cost",), lambda s: s.num("shipping_cost") < 0,
             "Negative shipping cost may indicate credits or invalid cost capture.",
             "Validate cost sign conventions before reporting freight cost."),
        Rule("missing carrier", "warning", ("carrier",), lambda s: s.blank("carrier"),
             "Missing carriers weaken carrier performance reporting.", "Backfill carrier names where possible."),
    ],
    "finance": [
        Rule("amount missing or non-numeric", "critical", ("amount",), lambda s: s.num("amount").isNull(),
             "Non-numeric or missing amounts cannot be included in finance KPIs.",
             "Correct amount formatting and missing values."),
        Rule("amount equals zero", "warning", ("amount",), lambda s: s.num("amount") == 0,
             "Zero-amount rows may be placeholders or corrections.",
             "Review zero-value transactions before financial reporting."),
        Rule("date missing", "critical", ("date",), lambda s: s.date("date").isNull(),
             "Rows without valid dates cannot support monthly finance analysis.", "Standardize transaction dates."),
        Rule("type not interpretable as revenue or cost", "critical", ("type",), _interpretable,
             "Finance KPIs require reliable revenue/cost type values.",
             "Normalize type values to revenue or cost before KPI reporting."),
        Rule("budget and actual non-numeric", "warning", ("budget", "actual"),
             lambda s: ((s.num("budget").isNull() & s.raw("budget").isNotNull())
                        | (s.num("actual").isNull() & s.raw("actual").isNotNull())),
             "Non-numeric budget or actual values prevent variance analysis.",
             "Convert budget and actual fields to numeric values."),
    ],
}


def active_rules(df: DataFrame, template_id: str, mapping: dict[str, str | None]) -> list[tuple[Rule, Column]]:
    src = _Src(df, mapping)
    return [(r, as_bool_flag(r.mask(src))) for r in RULES.get(template_id, []) if src.has(*r.fields)]


def template_rules(df: DataFrame, template_id: str, mapping: dict[str, str | None]) -> DataFrame:
    """One row per applicable rule: counts from a single aggregate over the source."""
    rules = active_rules(df, template_id, mapping)
    schema = ("template string, rule_name string, severity string, affected_rows_count bigint, "
              "affected_percentage double, explanation string, recommended_fix string")
    if not rules:
        return df.sparkSession.createDataFrame([], schema)
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(m).alias(f"_r{i}") for i, (_, m) in enumerate(rules)])
    label = RULE_TEMPLATE_LABELS[template_id]
    rows = [F.struct(F.lit(label).alias("template"), F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity"),
                     F.col(f"_r{i}").cast("long").alias("affected_rows_count"),
                     F.round(F.col(f"_r{i}") / F.greatest(F.col("_n"), F.lit(1)) * 100, 2).alias("affected_percentage"),
                     F.lit(r.explanation).alias("explanation"), F.lit(r.fix).alias("recommended_fix"))
            for i, (r, _) in enumerate(rules)]
    return counts.select(F.inline(F.array(*rows)))


def severity_summary(rules: DataFrame) -> DataFrame:
    """critical / warning / info: number of rules, of rules that some row breaks, and of rows they hit (three fixed rows)."""
    levels = rules.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counts = rules.groupBy("severity").agg(F.count(F.lit(1)).alias("rule_count"), F.count_if(F.col("affected_rows_count") > 0).alias("violated_rules"),
                                           F.sum("affected_rows_count").alias("affected_rows"))
    return F.broadcast(levels).join(counts, "severity", "left").select(
        "severity", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rule_count", "violated_rules", "affected_rows")])


def issue_rows(df: DataFrame, template_id: str, mapping: dict[str, str | None], id_col: str = "source_row_id",
               rule_name: str | None = None) -> DataFrame:
    """One output row per (source row, violated rule): id, rule, severity + all columns."""
    rules = [(r, m) for r, m in active_rules(df, template_id, mapping) if rule_name is None or r.name == rule_name]
    hits = F.array(*[F.when(m, F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity")))
                     for r, m in rules]) if rules else F.array()
    data_cols = [c for c in df.columns if c != id_col]
    exploded = df.select(F.col(id_col).alias("source_row_index"), *[F.col(f"`{c}`") for c in data_cols],
                         F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("_hit"))
    return exploded.select("source_row_index", "_hit.rule_name", "_hit.severity", *[F.col(f"`{c}`") for c in data_cols])


def generic_issue_rows(df: DataFrame, id_col: str = "source_row_id") -> DataFrame:
    """Rows with any missing value, and every member of a group of identical rows."""
    data_cols = [c for c in df.columns if c != id_col]
    any_null = F.lit(False)
    for c in data_cols:
        any_null = any_null | F.col(f"`{c}`").isNull()
    # Members of duplicate groups: grouped count (map-side combined) joined back; AQE
    # splits a hot group in the join instead of a window pulling it into one task.
    groups = (df.groupBy(*[F.col(f"`{c}`") for c in data_cols]).agg(F.count(F.lit(1)).alias("_copies"))
              .filter(F.col("_copies") > 1))
    keys = [f"_k{i}" for i in range(len(data_cols))]
    dups = groups.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(data_cols, keys)], F.lit(True).alias("_dup"))
    cond = None
    for c, k in zip(data_cols, keys):
        e = df[f"`{c}`"].eqNullSafe(dups[k])
        cond = e if cond is None else cond & e
    flagged = df.join(dups, cond, "left").drop(*keys)
    hits = F.array(F.when(any_null, F.struct(F.lit("row contains missing values").alias("rule_name"),
                                             F.lit("warning").alias("severity"))),
                   F.when(F.coalesce(F.col("_dup"), F.lit(False)),
                          F.struct(F.lit("duplicate row").alias("rule_name"), F.lit("warning").alias("severity"))))
    exploded = flagged.select(F.col(id_col).alias("source_row_index"), *[F.col(f"`{c}`") for c in data_cols],
                              F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("_hit"))
    return exploded.select("source_row_index", "_hit.rule_name", "_hit.severity", *[F.col(f"`{c}`") for c in data_cols])


# ---- Score ---------------------------------------------------------------------------------

def _score(rate: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.lit(1.0) - rate) * 100)), 1)


def score(df: DataFrame, mapping: dict[str, str | None] | None = None, required_fields: list[str] | None = None,
          date_fields: list[str] | None = None, numeric_fields: list[str] | None = None,
          exclude: list[str] | None = None) -> DataFrame:
    """Weighted 0-100 score over the assessed dimensions (one aggregate + one duplicate count).

    ``exclude`` columns (row identity) are left out of every dimension.
    """
    from sparkwright.operators.profile import duplicate_rows
    exclude = set(exclude or [])
    cols = [c for c in df.columns if c not in exclude]
    data = df.select(*[F.col(f"`{c}`") for c in cols])
    mapping = mapping or {}
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs.append(sum([F.count_if(F.col(f"`{c}`").isNull()) for c in cols[1:]], F.count_if(F.col(f"`{cols[0]}`").isNull()))
                .alias("missing_cells"))
    checked, invalid = [], []
    numeric_cols = [mapping[f] for f in (numeric_fields or []) if mapping.get(f)]
    for fld, column in mapping.items():
        if numeric_fields and fld not in numeric_fields:
            continue
        if not column or column not in cols:
            continue
        raw = F.col(f"`{column}`")
        num = to_number(raw, data.schema[column].dataType)
        checked.append(F.count(raw))
        invalid.append(F.count_if(raw.isNotNull() & num.isNull()))
        if fld == "unit_price":
            invalid.append(F.count_if(num <= 0))
        elif fld == "quantity":
            invalid.append(F.count_if(num == 0))
    if not numeric_cols:
        from sparkwright.functions import is_numeric_type
        for f in data.schema.fields:
            if is_numeric_type(f.dataType):
                v = F.col(f"`{f.name}`").cast("double")
                checked.append(F.count_if(v.isNotNull() & ~F.isnan(v)))
                invalid.append(F.count_if(F.abs(v) == F.lit(float("inf"))))
    zero = F.lit(0).cast("long")
    aggs.append(sum(checked, zero).alias("numeric_checked"))
    aggs.append(sum(invalid, zero).alias("invalid_numeric_count"))
    date_cols = [mapping[f] for f in (date_fields or []) if mapping.get(f)]
    date_cols_present = [c for c in date_cols if c in cols]
    dchecked = [F.count(F.col(f"`{c}`")) for c in date_cols_present]
    dfail = [F.count_if(F.col(f"`{c}`").isNotNull() & parse_dates(F.col(f"`{c}`"), data.schema[c].dataType).isNull())
             for c in date_cols_present]
    aggs.append(sum(dchecked, zero).alias("date_checked"))
    aggs.append(sum(dfail, zero).alias("date_parse_failures"))
    facts = attach_row(data.agg(*aggs), duplicate_rows(data))

    rows = F.greatest(F.col("rows"), F.lit(1))
    total_cells = F.greatest(F.col("rows") * F.lit(len(cols)), F.lit(1))
    missing_score = _score(F.col("missing_cells") / total_cells)
    dup_score = _score(F.col("duplicate_row_count") / rows)
    numeric_score = _score(F.col("invalid_numeric_count") / F.greatest(F.col("numeric_checked"), F.lit(1)))
    schema_assessed = bool(required_fields) and mapping is not None
    if schema_assessed:
        mapped = [f for f in required_fields if mapping.get(f) in cols]
        schema_score = F.lit(round(len(mapped) / len(required_fields) * 100, 1))
    else:
        schema_score = F.lit(None).cast("double")
    date_assessed = bool(date_cols)
    date_score = _score(F.col("date_parse_failures") / F.greatest(F.col("date_checked"), F.lit(1))) \
        if date_assessed else F.lit(None).cast("double")
    parts = [(missing_score, WEIGHTS["missing_values"]), (dup_score, WEIGHTS["duplicate_rows"]),
             (numeric_score, WEIGHTS["invalid_numeric_values"])]
    if schema_assessed:
        parts.append((schema_score, WEIGHTS["schema_completeness"]))
    if date_assessed:
        parts.append((date_score, WEIGHTS["date_parsing"]))
    total_weight = sum(w for _, w in parts)
    overall = F.round(sum([s * F.lit(w) for s, w in parts[1:]], parts[0][0] * F.lit(parts[0][1])) / F.lit(total_weight), 1)
    return facts.select(
        overall.alias("overall_score"),
        missing_score.alias("missing_values_score"),
        dup_score.alias("duplicate_rows_score"),
        numeric_score.alias("invalid_numeric_values_score"),
        schema_score.cast("double").alias("schema_completeness_score"),
        date_score.cast("double").alias("date_parsing_score"),
        F.col("rows").alias("row_count"),
        (F.col("rows") * F.lit(len(cols))).alias("total_cells"),
        "missing_cells", F.col("duplicate_row_count").alias("duplicate_rows"),
        "invalid_numeric_count", "numeric_checked", "date_parse_failures", "date_checked")


def score_report(score_row: DataFrame, schema_assessed: bool = True, date_assessed: bool = True) -> DataFrame:
    """(section, metric, value) rows: overall, sub-scores, metrics, explanations and fixes.

    Fixed values: all sentences below, and the thresholds that bring them up.
    """
    def fmt_pct(num: Column, den: Column) -> Column:
        return F.format_string("%.1f%%", F.round(num / F.greatest(den, F.lit(1)) * 100, 1))

    r = [("overall", "overall_score", F.col("overall_score").cast("string")),
         ("sub_score", "missing_values", F.col("missing_values_score").cast("string")),
         ("sub_score", "duplicate_rows", F.col("duplicate_rows_score").cast("string")),
         ("sub_score", "invalid_numeric_values", F.col("invalid_numeric_values_score").cast("string"))]
    if schema_assessed:
        r.append(("sub_score", "schema_completeness", F.col("schema_completeness_score").cast("string")))
    if date_assessed:
        r.append(("sub_score", "date_parsing", F.col("date_parsing_score").cast("string")))
    for m in ["missing_cells", "duplicate_rows", "invalid_numeric_count", "date_parse_failures"]:
        r.append(("metric", m, F.col(m).cast("string")))
    r += [
        ("explanation", "note", F.format_string("Missing values: %d missing cells across %d total cells (%s).",
                                                F.col("missing_cells"), F.col("total_cells"),
                                                fmt_pct(F.col("missing_cells"), F.col("total_cells")))),
        ("explanation", "note", F.format_string("Duplicate rows: %d duplicate rows out of %d rows (%s).",
                                                F.col("duplicate_rows"), F.col("row_count"),
                                                fmt_pct(F.col("duplicate_rows"), F.col("row_count")))),
        ("explanation", "note", F.format_string("Invalid numeric values: %d issues across %d checked values.",
                                                F.col("invalid_numeric_count"),
                                                F.greatest(F.col("numeric_checked"), F.lit(1)))),
        ("explanation", "note", F.format_string("Schema completeness: %.1f%% of required template fields are mapped.",
                                                F.col("schema_completeness_score")) if schema_assessed else
         F.lit("Schema completeness: not assessed until a domain template is selected.")),
        ("explanation", "note", F.format_string("Date parsing: %d failures across %d checked date values.",
                                                F.col("date_parse_failures"), F.greatest(F.col("date_checked"), F.lit(1)))
         if date_assessed else F.lit("Date parsing: not assessed because no template date field was provided.")),
    ]
    fixes = [
        F.when(F.col("missing_values_score") < 95, F.lit(
            "Review high-missing columns and decide whether to impute, backfill, or exclude them.")),
        F.when(F.col("duplicate_rows") > 0, F.lit(
            "Investigate duplicate rows before KPI reporting; keep an audit trail if removing them.")),
        F.when(F.col("invalid_numeric_count") > 0, F.lit(
            "Correct or exclude invalid numeric values such as non-numeric quantities or unit prices <= 0.")),
    ]
    if schema_assessed:
        fixes.append(F.when(F.col("schema_completeness_score") < 100,
                            F.lit("Complete required field mapping before using domain-specific analytics.")))
    if date_assessed:
        fixes.append(F.when(F.col("date_parse_failures") > 0,
                            F.lit("Standardize date formats or provide explicit parsing rules.")))
    arr = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), v.alias("value")) for s, m, v in r])
    fix_arr = F.filter(F.array(*fixes), lambda x: x.isNotNull())
    fix_rows = F.when(F.size(fix_arr) > 0, F.transform(fix_arr, lambda x: F.struct(
        F.lit("recommended_fix").alias("section"), F.lit("fix").alias("metric"), x.alias("value")))).otherwise(
        F.array(F.struct(F.lit("recommended_fix").alias("section"), F.lit("fix").alias("metric"),
                         F.lit("No major data quality issues were detected by the current rules.").alias("value"))))
    return score_row.select(F.inline(F.concat(arr, fix_rows)))


# Date and numeric fields assessed by the template-aware score.
SCORE_FIELDS = {
    "sales_retail": (["order_date"], ["quantity", "unit_price"]),
    "manufacturing": (["timestamp"], ["actual_output", "scrap_count", "downtime_minutes"]),
    "logistics": (["order_date", "delivery_date", "planned_delivery_date"], ["shipping_cost"]),
    "finance": (["date"], ["amount", "budget", "actual"]),
}


def template_score(df: DataFrame, template_id: str, mapping: dict[str, str | None], exclude=None) -> DataFrame:
    date_fields, numeric_fields = SCORE_FIELDS[template_id]
    return score(df, mapping, get_template(template_id).required, date_fields, numeric_fields, exclude)

"""Opt-in approximate profile from mergeable sketches; the exact profile stays the default.

A sketch row holds, for one column of one file, its row and value counts and a sketch of its
values: HyperLogLog for distinct values, KLL for quantiles of numbers, heavy hitters for text.
Rows of many files (or loads) merge by column, so a table that grows is sketched file by
file, each once; the rows can be stored with ``write_table`` and are of bounded size.

Stated errors: distinct counts ``UNIQUE_ERROR`` (four standard errors, relative), quantiles
``RANK_ERROR`` (share of the column's values by which the rank may be off), counts of the most
common values ``COUNT_ERROR`` (share of the column's values). NaN counts as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions import to_number
from sparkwright.operators.common import attach_row
from sparkwright.operators.profile import as_text, value_counts

LOG_REGISTERS, KLL_K, ITEMS = 14, 1000, 1000
UNIQUE_ERROR = 4 * 1.04 / 2 ** (LOG_REGISTERS / 2)
RANK_ERROR = 0.01
COUNT_ERROR = 3.5 / ITEMS
QUANTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def sketch(df: DataFrame, numeric: list[str], text: list[str], by: Column | None = None) -> DataFrame:
    """(part, column, rows, present, uniques, quantiles, items): one row per file and column.

    ``by`` names the parts; without it ``df`` must be a scan of files.
    """
    by = F.col("_metadata.file_path") if by is None else by
    columns = [*numeric, *text]
    proj = [as_text(df, c).alias(f"v{i}") for i, c in enumerate(columns)]
    proj += [to_number(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"n{i}") for i, c in enumerate(numeric)]
    rows = df.select(by.cast("string").alias("part"), *proj)
    aggs = [F.count(F.lit(1)).alias("rows")]
    made = []
    for i, c in enumerate(columns):
        aggs += [F.count(f"v{i}").alias(f"p{i}"), F.hll_sketch_agg(f"v{i}", LOG_REGISTERS).alias(f"u{i}")]
        if i < len(numeric):
            aggs.append(F.kll_sketch_agg_double(f"n{i}", KLL_K).alias(f"q{i}"))
        else:
            aggs.append(F.expr(f"approx_top_k_accumulate(v{i}, {ITEMS})").alias(f"t{i}"))
    wide = rows.groupBy("part").agg(*aggs)
    first = len(numeric)
    for i, c in enumerate(columns):
        quantiles = F.col(f"q{i}") if i < first else F.lit(None).cast("binary")
        items = F.col(f"t{i}") if i >= first else F.lit(None)
        made.append(F.struct(F.lit(c).alias("column"), "rows", F.col(f"p{i}").alias("present"), F.col(f"u{i}").alias("uniques"),
                             quantiles.alias("quantiles"), items.alias("items")))
    return wide.select("part", F.inline(F.array(*made)))


def merge(sketches: DataFrame) -> DataFrame:
    """(column, rows, present, uniques, quantiles, items) of all parts together."""
    common = [F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.hll_union_agg("uniques").alias("uniques")]
    numbers = sketches.where("quantiles is not null").groupBy("column").agg(*common, F.kll_merge_agg_double("quantiles", KLL_K).alias("quantiles"))
    if sketches.schema["items"].dataType.typeName() == "void":
        return numbers.withColumn("items", F.lit(None))
    texts = sketches.where("items is not null").groupBy("column").agg(*common, F.expr(f"approx_top_k_combine(items, {ITEMS})").alias("items"))
    return numbers.unionByName(texts, allowMissingColumns=True)


def profile(merged: DataFrame) -> DataFrame:
    """(column, rows, present, unique_values, q1, median, q3, most_common, most_common_count), all but the counts of rows approximate.

    A column without values has no quantile and no most common value.
    """
    some = F.col("present") > 0
    out = [F.when(some & F.col("quantiles").isNotNull(), F.kll_sketch_get_quantile_double("quantiles", F.lit(p))).alias(name) for name, p in QUANTILES.items()]
    if merged.schema["items"].dataType.typeName() == "void":
        common = [F.lit(None).cast("string").alias("most_common"), F.lit(None).cast("long").alias("most_common_count")]
    else:
        best = F.when(some & F.col("items").isNotNull(), F.get(F.expr("approx_top_k_estimate(items, 1)"), F.lit(0)))
        common = [best["item"].alias("most_common"), best["count"].alias("most_common_count")]
    return merged.select("column", "rows", "present", F.hll_sketch_estimate("uniques").alias("unique_values"), *out, *common)


def beside_exact(df: DataFrame, approximate: DataFrame, columns: list[str]) -> DataFrame:
    """Exact values of each column, and whether the approximate ones lie within the stated errors."""
    counts = value_counts(df, columns)
    one = approximate.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct(*approximate.columns)))).alias("all"))  # a row per column
    joined = attach_row(counts, one).withColumn("a", F.col("all")[F.col("column")])
    value = F.col("value").try_cast("double")
    shares = [F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(f"{name}_{side}") for name in QUANTILES
              for side, cond in (("below", value < F.col(f"a.{name}")), ("upto", value <= F.col(f"a.{name}")))]
    held = F.sum(F.when(F.col("value") == F.col("a.most_common"), F.col("n")).otherwise(0)).alias("held")
    x = joined.groupBy("column").agg(F.first("a").alias("a"), F.count(F.lit(1)).alias("unique_values"), F.max("n").alias("most_common_count"),
                                     F.sum("n").alias("present"), held, *shares)
    n = F.col("present")
    ranks = F.lit(True)
    for name, p in QUANTILES.items():
        ranks = ranks & ((F.col(f"{name}_below") <= (p + RANK_ERROR) * n) & (F.col(f"{name}_upto") >= (p - RANK_ERROR) * n))
    slack = F.lit(COUNT_ERROR) * n
    return x.select(
        "column", "present", "unique_values", (F.abs(F.col("a.unique_values") - F.col("unique_values")) <= F.lit(UNIQUE_ERROR) * F.col("unique_values")).alias("unique_in_bound"),
        F.when(F.col("a.median").isNotNull(), ranks).alias("quantiles_in_bound"),
        F.when(F.col("a.most_common").isNotNull(), F.col("most_common_count")).alias("most_common_count"),
        F.when(F.col("a.most_common").isNotNull(), (F.abs(F.col("a.most_common_count") - F.col("held")) <= slack) & (F.col("held") >= F.col("most_common_count") - slack)).alias("common_in_bound"))

"""Global order statistics without a single-partition window.

Quantiles are selected by counts alone (:func:`exact_quantiles`). Ranks and row ids need an
order: ``Window.orderBy(v)`` with no partition moves every row into one task, so rows (or the
distinct values with their counts) are range-partitioned and sorted on the full key, written
once to the shared folder together with their partition number, and finished with a running
sum inside each partition plus the totals of the partitions before it. The written copy is
what makes the numbers stable: bounds of a range partitioning are sampled, and a second
evaluation may cut elsewhere. The number of partitions is the session's own setting; keys
of any orderable type work, and no single value of the first key column matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.sources.readers import with_scan_row_id
from sparkwright.sources.sinks import stage_table


def _ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` cut into ranges of ``keys``, with the range number ``_part`` (ascending)."""
    cols = [F.col(f"`{k}`") for k in keys]
    return stage_table(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()), "ranged")


def _totals_before(parts: DataFrame, total: str, group: list[str]) -> DataFrame:
    """``parts`` (one row per group and range) with ``_offset``: the total of earlier ranges."""
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_offset", F.coalesce(F.sum(total).over(earlier), F.lit(0))).drop(total)


def prefix_before(counts: DataFrame, value_col: str, weight_col: str, group_cols: list[str] | None = None,
                  out_col: str = "_before") -> DataFrame:
    """For each (group, distinct value) row: total weight of strictly smaller values.

    ``counts`` holds one row per (group, value). A range holds few groups or part of one, so
    the table of totals has at most ranges + groups rows.
    """
    group = list(group_cols or [])
    ranged = _ranged(counts.filter(F.col(value_col).isNotNull()), [*group, value_col])
    parts = _totals_before(ranged.groupBy(*group, "_part").agg(F.sum(weight_col).alias("_total")), "_total", group)
    inside = Window.partitionBy(*group, "_part").orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_inside", F.coalesce(F.sum(weight_col).over(inside), F.lit(0)))
    return (summed.join(parts, [*group, "_part"])
            .withColumn(out_col, F.col("_offset") + F.col("_inside")).drop("_offset", "_inside", "_part"))


def _counted(df: DataFrame, value_col: str, group: list[str]) -> DataFrame:
    """Distinct values with their count ``_t``, the weight before them and the group total ``_n``."""
    counts = df.filter(F.col(value_col).isNotNull()).groupBy(*group, value_col).agg(F.count(F.lit(1)).alias("_t"))
    ranked = prefix_before(counts, value_col, "_t", group)
    n = ranked.groupBy(*group).agg(F.sum("_t").alias("_n"))
    return ranked.join(n, group) if group else ranked.withColumn("_n", n.scalar())


def average_percent_rank(df: DataFrame, value_col: str, out_col: str, group_cols: list[str] | None = None) -> DataFrame:
    """Per distinct value: average rank / n (ties share the mean of their ranks).

    Returns (group..., value, out_col, _n). Nulls are not ranked.
    """
    group = list(group_cols or [])
    ranked = _counted(df, value_col, group)
    average = F.col("_before") + (F.col("_t") + F.lit(1)) / F.lit(2)
    return ranked.select(*group, value_col, (average / F.col("_n")).alias(out_col), "_n")


_TOP = 1 << 52  # doubles have 52 bits behind the leading one


def order_key(value: Column) -> Column:
    """The bits of a double as a long that sorts like the double (-0.0 is 0.0; NaN comes last); never null."""
    v = value.cast("double")
    size = F.abs(v)
    guess = F.floor(F.log2(size)).cast("int")
    power = guess + F.when(size < F.pow(F.lit(2.0), guess), -1).when(size / 2 >= F.pow(F.lit(2.0), guess), 1).otherwise(0)
    normal = (power + 1023).cast("long") * F.lit(_TOP) + ((size / F.pow(F.lit(2.0), power) - 1) * F.lit(float(_TOP))).cast("long")
    tiny = (size * F.pow(F.lit(2.0), F.lit(1000)) * F.pow(F.lit(2.0), F.lit(74))).cast("long")
    bits = (F.when(F.isnan(v), F.lit(2047 * _TOP + 1)).when(size == float("inf"), F.lit(2047 * _TOP))
            .when(size < 2.0 ** -1022, tiny).otherwise(normal))
    return F.coalesce(F.when(v < 0, -bits).otherwise(bits), F.lit(0))


def key_value(key: Column) -> Column:
    """The double of an :func:`order_key`."""
    k = F.abs(key)
    power, rest = F.shiftright(k, 52).cast("int"), k.bitwiseAND(F.lit(_TOP - 1)).cast("double")
    normal = (rest / F.lit(float(_TOP)) + 1) * F.pow(F.lit(2.0), power - 1023)
    tiny = rest * F.pow(F.lit(2.0), F.lit(-1000)) * F.pow(F.lit(2.0), F.lit(-74))
    size = F.when(k > 2047 * _TOP, F.lit(float("nan"))).when(k == 2047 * _TOP, F.lit(float("inf"))).when(power == 0, tiny).otherwise(normal)
    return F.when(key < 0, -size).otherwise(size)


def _digit(place: int) -> Column:
    """Sixteen bits of ``_k``, the highest first (and signed)."""
    shifted = F.shiftright(F.col("_k"), 48 - 16 * place)
    return shifted if place == 0 else shifted.bitwiseAND(F.lit(65535))


def exact_quantiles(df: DataFrame, value_col: str, quantiles: dict[str, float],
                    group_cols: list[str] | None = None, weight_col: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles (the ``quantile_cont`` rule) of numbers.

    Radix selection: values become 64-bit keys in their order, are counted once, and the key at
    every wanted rank is found sixteen bits at a time from counts per digit, for all groups
    and quantiles in the same four passes. The passes share the exchange of the counted keys; nothing is
    sorted or written, and a window sees at most 65,536 digits of a group and rank. With
    ``weight_col`` a row stands for that many. One row per group; without groups one row,
    null when there is no value.
    """
    group = list(group_cols or [])
    weight = F.sum(F.col(weight_col).cast("long")) if weight_col else F.count(F.lit(1))
    counts = (df.filter(F.col(f"`{value_col}`").isNotNull()).select(*group, order_key(F.col(f"`{value_col}`")).alias("_k"), *([weight_col] if weight_col else []))
              .groupBy(*group, "_k").agg(weight.alias("_w")))
    names = list(quantiles)
    wanted = F.array(*[F.struct(F.lit(2 * i + up).alias("_t"), F.lit(float(quantiles[n])).alias("_q")) for i, n in enumerate(names) for up in (0, 1)])

    def located(digits: DataFrame, by: list[str]) -> DataFrame:
        """The digit that holds rank ``_r``, with the rank inside it."""
        upto = Window.partitionBy(*by).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
        placed = digits.withColumn("_upto", F.sum("_w").over(upto))
        return placed.where((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_w")))

    first = counts.groupBy(*group, _digit(0).alias("_d")).agg(F.sum("_w").alias("_w"))
    n = F.sum("_w").over(Window.partitionBy(*group))
    ranked = first.withColumn("_n", n).withColumn("_want", F.explode(wanted)).select(*group, "_d", "_w", "_n", "_want.*")
    at = F.col("_q") * (F.col("_n") - 1)
    ranked = ranked.select(*group, "_t", "_d", "_w", (at - F.floor(at)).alias("_part"), F.when(F.col("_t") % 2 == 0, F.floor(at)).otherwise(F.ceil(at)).alias("_r"))
    by = [*group, "_t"]
    found = located(ranked, by).select(*by, "_part", (F.col("_r") - F.col("_upto") + F.col("_w")).alias("_r"), F.col("_d").alias("_p"))
    for place in (1, 2, 3):
        prefix = F.shiftright(F.col("_k"), 64 - 16 * place)
        part = counts.select(*group, prefix.alias("_p"), _digit(place).alias("_d"), "_w")
        digits = part.join(found, [*group, "_p"]).groupBy(*by, "_part", "_r", "_p", "_d").agg(F.sum("_w").alias("_w"))
        found = located(digits, by).select(*by, "_part", (F.col("_r") - F.col("_upto") + F.col("_w")).alias("_r"),
                                           (F.col("_p") * F.lit(65536) + F.col("_d")).alias("_p"))
    picked = []
    for i, name in enumerate(names):
        lo, hi = (F.max(F.when(F.col("_t") == 2 * i + up, key_value(F.col("_p")))) for up in (0, 1))
        part = F.max(F.when(F.col("_t") == 2 * i, F.col("_part")))
        picked.append((lo + (hi - lo) * part).alias(name))
    return found.groupBy(*group).agg(*picked)


def exact_quantile(df: DataFrame, value_col: str, q: float, out_col: str = "quantile",
                   group_cols: list[str] | None = None, weight_col: str | None = None) -> DataFrame:
    return exact_quantiles(df, value_col, {out_col: q}, group_cols, weight_col)


def with_row_id(df: DataFrame, order_cols: list[str], out_col: str = "source_row_id") -> DataFrame:
    """Dense 0-based row id following ``order_cols`` (which must identify rows), nulls last.

    Ranges of the key are sorted and written once, a file each and named in their order, so the id
    is the place in the file plus the rows of the files before it: no second shuffle or sort.
    """
    cols = [F.asc_nulls_last(f"`{c}`") for c in order_cols]
    return with_scan_row_id(stage_table(df.repartitionByRange(*cols).sortWithinPartitions(*cols), "ranged"), out_col)

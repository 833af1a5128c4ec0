"""Column profiling for any table.

Per-column facts come from one wide aggregate (null counts, parse counts, min/max) and
one long ``(column, value)`` count table shared by the distinct counts, the most
common values and the dictionary examples. Many exact distincts in one aggregate would
make Spark expand every row once per column anyway; the long form makes that one
explicit, map-side-combined shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.functions import is_numeric_type, is_string_type, parse_dates, to_number
from sparkwright.operators.common import attach_row
from sparkwright.operators.ranking import exact_quantiles

# Detection thresholds.
PROFILE_NUMERIC_SHARE = 0.9
PROFILE_DATE_SHARE = 0.75
# Fixed values: "large dataset" guards (rows, columns, megabytes).
LARGE_ROWS = 100_000
LARGE_COLUMNS = 75
LARGE_MEGABYTES = 50


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _is_dt(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def as_text(df: DataFrame, name: str) -> Column:
    """Text view of a value for distinct counting: -0.0 folds into 0.0, NaN is missing."""
    dtype = df.schema[name].dataType
    col = _c(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        col = F.when(F.isnan(col), F.lit(None)).when(col == 0, F.lit(0.0)).otherwise(col)
    return col.cast("string")


def detect_types(df: DataFrame) -> DataFrame:
    """(pos, column, dtype, non_null, numeric_share, date_share, kind) from one aggregate.

    kind: numeric (numeric type, or text with >= 90% parseable numbers), date (date
    type, or non-numeric text with >= 75% parseable dates), categorical (other text or
    boolean), other. Text is parsed once per value in a projection under the aggregate.
    """
    proj, aggs = [], []
    for i, (name, dtype) in enumerate(df.dtypes):
        t = df.schema[name].dataType
        proj.append(_c(name).alias(f"_v{i}"))
        aggs.append(F.count(f"_v{i}").alias(f"nn{i}"))
        if is_string_type(t):
            proj += [to_number(_c(name), t).alias(f"_n{i}"), parse_dates(_c(name), t).alias(f"_d{i}")]
            aggs += [F.count(f"_n{i}").alias(f"num{i}"), F.count(f"_d{i}").alias(f"date{i}")]
    wide = df.select(*proj).agg(*aggs)
    rows = []
    for i, (name, dtype) in enumerate(df.dtypes):
        t = df.schema[name].dataType
        nn = F.col(f"nn{i}")
        if is_string_type(t):
            num_share = F.when(nn > 0, F.col(f"num{i}") / nn).otherwise(F.lit(0.0))
            date_share = F.when(nn > 0, F.col(f"date{i}") / nn).otherwise(F.lit(0.0))
            kind = (F.when(num_share >= PROFILE_NUMERIC_SHARE, "numeric")
                    .when(date_share >= PROFILE_DATE_SHARE, "date").otherwise("categorical"))
        else:
            is_num = is_numeric_type(t)
            num_share = F.lit(1.0 if is_num else 0.0)
            date_share = F.lit(1.0 if _is_dt(t) else 0.0)
            kind = F.lit("numeric" if is_num else "date" if _is_dt(t) else
                         "categorical" if isinstance(t, T.BooleanType) else "other")
        rows.append(F.struct(F.lit(i).alias("pos"), F.lit(name).alias("column"), F.lit(dtype).alias("dtype"),
                             nn.alias("non_null"), num_share.cast("double").alias("numeric_share"),
                             date_share.cast("double").alias("date_share"), kind.alias("kind")))
    return wide.select(F.inline(F.array(*rows)))


def missing_table(df: DataFrame) -> DataFrame:
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(_c(c).isNull()).alias(f"m_{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"m_{i}").alias("missing_count")) for i, c in
            enumerate(df.columns)]
    long = wide.select("_rows", F.inline(F.array(*rows)))
    return long.select("column", "missing_count",
                       F.round(F.col("missing_count") / F.greatest(F.col("_rows"), F.lit(1)) * 100, 2)
                       .alias("missing_percentage"))


def dtype_table(df: DataFrame) -> list[tuple[str, str]]:
    return list(df.dtypes)


def value_counts(df: DataFrame, columns: list[str] | None = None, order_cols: list[str] | None = None) -> DataFrame:
    """(column, value, n[, first]) over non-null values: the shared long count table.

    ``first`` is the smallest ``order_cols`` value holding the value (source order). A
    single long order column (a row id) keeps this a hash aggregate; several columns
    are compared as a struct, which Spark can only sort-aggregate.
    """
    columns = list(columns or df.columns)
    if not order_cols:
        order = None
    elif len(order_cols) == 1:
        order = _c(order_cols[0])
    else:
        order = F.struct(*[_c(c) for c in order_cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), as_text(df, c).alias("value")) for c in columns])
    base = df.select(F.explode(pairs).alias("p"), *([order.alias("_o")] if order is not None else []))
    base = base.select("p.column", "p.value", *(["_o"] if order is not None else []))
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.min("_o").alias("first")] if order is not None else [])
    return base.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(*aggs)


def unique_table(counts: DataFrame, columns: list[str]) -> DataFrame:
    seen = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_values"))
    names = counts.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    # One row per column of the profiled table: bounded by its schema width.
    return F.broadcast(names).join(seen, "column", "left").select(
        "column", F.coalesce("unique_values", F.lit(0)).cast("long").alias("unique_values"))


def categorical_summary(counts: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct count, most common value (ties: smallest value) and its count."""
    per = counts.filter(F.col("column").isin(columns)).groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_values"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("most_common"),
        F.max("n").alias("most_common_count"))
    names = counts.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return F.broadcast(names).join(per, "column", "left").select(
        "column", F.coalesce("unique_values", F.lit(0)).cast("long").alias("unique_values"), "most_common",
        F.coalesce("most_common_count", F.lit(0)).cast("long").alias("most_common_count"))


def numeric_long(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), to_number(_c(c), df.schema[c].dataType).alias("value"))
                      for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear), max per numeric column; 2 dp."""
    long = numeric_long(df, columns).filter(F.col("value").isNotNull())
    stats = long.groupBy("column").agg(
        F.count("value").cast("double").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    # values are counted before they become keys: many columns hold few of them
    counted = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    quartiles = exact_quantiles(counted, "value", {"25%": 0.25, "50%": 0.5, "75%": 0.75}, ["column"], "n")
    joined = stats.join(quartiles, "column", "left")
    return joined.select("column", *[F.round(F.col(f"`{c}`"), 2).alias(c)
                                     for c in ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row exactly (nulls equal): one grouped count."""
    groups = df.groupBy(*[_c(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_row_count"))


def _kind_is(kind: str):
    return lambda s: s["kind"] == kind


def overview(df: DataFrame) -> DataFrame:
    """row_count, column_count, duplicate rows and the detected column lists."""
    kinds = detect_types(df).groupBy().agg(
        *[F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", "column", "kind"))),
                                            _kind_is(k)), lambda s: s["column"]), ",")
          .alias(f"{k}_columns") for k in ("numeric", "date", "categorical")])
    rows = df.agg(F.count(F.lit(1)).alias("row_count"))
    return (attach_row(attach_row(rows, duplicate_rows(df), "_d"), kinds, "_k")
            .select("row_count", F.lit(len(df.columns)).cast("long").alias("column_count"), "duplicate_row_count",
                    F.col("numeric_columns").alias("detected_numeric_columns"),
                    F.col("date_columns").alias("detected_date_columns"),
                    F.col("categorical_columns").alias("detected_categorical_columns")))


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins between the column's min and max: (bin, lower, upper, count)."""
    v = to_number(_c(column), df.schema[column].dataType)
    vals = df.select(v.alias("v")).filter(F.col("v").isNotNull())
    rng = vals.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    counted = attach_row(vals, rng).groupBy(b.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
    return counted.select("bin", (F.col("lo") + F.col("bin") * width).alias("lower"),
                          (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"), "count")


def value_frequency(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    c = _c(column)
    return (df.filter(c.isNotNull()).groupBy(c.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "value").limit(n))


def scatter_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return (df.select(to_number(_c(x), df.schema[x].dataType).alias(x), to_number(_c(y), df.schema[y].dataType).alias(y))
            .dropna())


def scatter_sample(df: DataFrame, x: str, y: str, bins: int = 20, per_bin: int = 25) -> DataFrame:
    """Opt-in sample of :func:`scatter_pairs` for drawing: (x, y, bin_x, bin_y, bin_rows).

    The pairs lie in a grid of ``bins`` x ``bins`` equal cells between minimum and maximum. Every
    cell keeps the ``per_bin`` pairs of least hash, a sparse one all of its pairs; ``bin_rows`` counts
    all pairs of the cell. The sample depends on the values alone, not on partitions or order.
    Equal pairs count as often as they stand; infinite values take no part.
    """
    pairs = scatter_pairs(df, x, y).where(f"abs(`{x}`) < double('infinity') and abs(`{y}`) < double('infinity')")
    ends = pairs.agg(*(f(_c(c)).alias(f"_{n}{i}") for i, c in enumerate((x, y)) for n, f in (("lo", F.min), ("hi", F.max))))

    def cell(c: str, i: int) -> Column:
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.when(hi == lo, 0).otherwise(F.least(F.floor((_c(c) - lo) / ((hi - lo) / F.lit(bins))), F.lit(bins - 1))).cast("int")

    mark = F.md5(F.concat_ws("|", _c(x).cast("string"), _c(y).cast("string")))
    placed = attach_row(pairs, ends).select(x, y, cell(x, 0).alias("bin_x"), cell(y, 1).alias("bin_y"), mark.alias("_mark"))
    full = placed.groupBy("bin_x", "bin_y").agg(F.count(F.lit(1)).alias("bin_rows"))  # at most bins x bins rows
    # the limit on the rank applies before the exchange too: a task sends per_bin pairs of a cell at most
    best = Window.partitionBy("bin_x", "bin_y").orderBy("_mark", _c(x), _c(y))
    few = placed.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= per_bin)
    return few.join(full, ["bin_x", "bin_y"]).select(x, y, "bin_x", "bin_y", "bin_rows")


def dataset_size(df: DataFrame) -> DataFrame:
    """rows, columns, estimated megabytes and the large-dataset flags (one aggregate)."""
    width = []
    for f in df.schema.fields:
        if is_string_type(f.dataType):
            width.append(F.coalesce(F.octet_length(_c(f.name)), F.lit(0)) + F.lit(49))
        else:
            width.append(F.lit(8))
    row_bytes = width[0] if len(width) == 1 else sum(width[1:], width[0])
    t = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes"))
    mb = F.round(F.col("bytes") / F.lit(1024 * 1024), 2)
    ncols = F.lit(len(df.columns)).cast("long")
    return t.select("rows", ncols.alias("columns"), mb.alias("memory_mb"),
                    (F.col("rows") >= LARGE_ROWS).alias("large_rows"), (ncols >= LARGE_COLUMNS).alias("wide_table"),
                    (mb >= LARGE_MEGABYTES).alias("large_memory"),
                    ((F.col("rows") >= LARGE_ROWS) | (ncols >= LARGE_COLUMNS) | (mb >= LARGE_MEGABYTES))
                    .alias("is_large"))


def row_key(df: DataFrame) -> Column:
    """60 bits of the md5 of a row. Every value carries its length and a null has a mark of its
    own, so no value can run into the next column."""
    parts = [F.concat(F.length(v).cast("string"), F.lit(":"), v) for v in (_c(c).cast("string") for c in df.columns)]
    text = F.concat(*[F.coalesce(p, F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def schema_text(df: DataFrame) -> str:
    return ",".join(f"{n}:{t}" for n, t in df.dtypes)


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash: row count, XOR and decimal sum of the row keys, plus the schema
    string; the pair of hashes keeps repeated rows from cancelling."""
    key = row_key(df)
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.bit_xor(key).alias("hash_xor"),
                  F.sum(key.cast("decimal(38,0)")).cast("string").alias("hash_sum")).withColumn("schema", F.lit(schema_text(df)))

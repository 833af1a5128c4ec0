"""Shared operators: canonical projection and keep-first duplicate flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.functions import as_bool_flag
from sparkwright.sources.sinks import stage_table

def attach_row(df: DataFrame, one_row: DataFrame, name: str = "_row") -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df``.

    The row travels as one struct-valued scalar subquery (computed once, shipped as a
    value): no join and no pairing of rows.
    """
    packed = one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns]).alias(name)).scalar()
    return df.select("*", packed.alias(name)).select(*[F.col(f"`{c}`") for c in df.columns], f"{name}.*")


def apply_mapping(df: DataFrame, mapping: dict[str, str | None], fields: list[str],
                  keep: list[str] | None = None) -> DataFrame:
    """One projection: canonical field <- mapped source column, null when unmapped.

    ``keep`` columns (row identity such as ``source_row_id``) ride along unchanged.
    """
    cols = []
    for field in fields:
        source = mapping.get(field)
        if source and source in df.columns:
            cols.append(F.col(f"`{source}`").alias(field))
        else:
            cols.append(F.lit(None).cast("string").alias(field))
    extra = [F.col(f"`{c}`") for c in (keep or []) if c in df.columns and c not in fields]
    return df.select(*cols, *extra)


def row_digest(df: DataFrame, columns: list[str]) -> list[Column]:
    """128 bits that agree exactly where all ``columns`` agree (null equals null, -0.0 equals 0.0).

    Two chained hashes over a bitmap of the nulls and the values: a value cannot slide into
    the neighbouring column, and a null is not the absence of a column.
    """
    nulls = F.concat_ws("", *[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in columns])
    plain = [F.col(f"`{c}`") + F.lit(0.0) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{c}`")
             for c in columns]
    return [F.xxhash64(nulls, *plain), F.xxhash64(F.lit(7), nulls, *plain)]


def flag_duplicates(df: DataFrame, subset: list[str], order_cols: list[str],
                    flag: str = "is_duplicate_row") -> DataFrame:
    """``flag`` is true on every copy but the first (smallest ``order_cols``) of each
    group of rows equal on ``subset`` (nulls equal, like pandas ``duplicated``).

    The keys are reduced to a 16-byte digest, and only digests are counted over all rows. Those
    that stand more than once are written, so that the planner knows their size: the rows meet
    them in a broadcast where they are few, else in a join that is split at runtime. Row keys are
    compared among repeated rows only. No window gathers a group. ``order_cols`` must identify rows.
    """
    first, second = row_digest(df, subset)
    marked = df.withColumns({"_d1": first, "_d2": second})
    order = F.struct(*[F.col(f"`{c}`") for c in order_cols]) if len(order_cols) > 1 else F.col(f"`{order_cols[0]}`")
    twice = stage_table(marked.groupBy("_d1", "_d2").agg(F.count(F.lit(1)).alias("_copies")).filter(F.col("_copies") > 1)
                        .select("_d1", "_d2"), "repeated")
    copies = marked.select("_d1", "_d2", order.alias("_key")).join(twice, ["_d1", "_d2"])
    repeated = stage_table(copies.groupBy("_d1", "_d2").agg(F.min("_key").alias("_first")), "repeated")
    joined = marked.join(repeated, ["_d1", "_d2"], "left")
    return joined.withColumn(flag, as_bool_flag(order != F.col("_first"))).drop("_first", "_d1", "_d2")


def distinct_records(df: DataFrame, fields: list[str], counted: list[str] = ()) -> DataFrame:
    """One row per distinct record (nulls equal) with ``copies``, and ``n_<column>``: how many copies have that column.

    What statistics need instead of a duplicate flag on every row: one aggregation over one
    evaluation of ``df``, combined map-side, so a record that fills a third of the table is
    one row per task. ``is_duplicate_row`` is false throughout.
    """
    counts = [F.count(F.col(f"`{c}`")).alias(f"n_{c}") for c in counted]
    return df.groupBy(*fields).agg(F.count(F.lit(1)).alias("copies"), *counts).withColumn("is_duplicate_row", F.lit(False))


def dedupe_keep_first(df: DataFrame, subset: list[str], order_cols: list[str]) -> DataFrame:
    """Drop all but the first copy of each group of rows equal on ``subset``."""
    flagged = flag_duplicates(df, subset, order_cols, "_dup")
    return flagged.filter(~F.col("_dup")).drop("_dup")

"""Interactive controls: date ranges, value filters, top-n, monthly sums, filter options."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.functions import exact_sum, parse_dates, to_number


def filter_date_range(df: DataFrame, column: str, start: dt.date | None, end: dt.date | None) -> DataFrame:
    """Inclusive calendar-day bounds; rows without a date are dropped.

    Written as a half-open range on the raw timestamp (``>= start`` and ``< end + 1 day``)
    so the predicate stays pushable into the Parquet scan.
    """
    if column not in df.columns:
        return df
    ts = parse_dates(F.col(f"`{column}`"), df.schema[column].dataType)
    cond = ts.isNotNull()
    if start is not None:
        cond = cond & (ts >= F.lit(dt.datetime.combine(start, dt.time())))
    if end is not None:
        cond = cond & (ts < F.lit(dt.datetime.combine(end + dt.timedelta(days=1), dt.time())))
    return df.filter(cond)


def filter_values(df: DataFrame, filters: dict[str, list]) -> DataFrame:
    """Per-column IN lists folded with AND; empty lists and unknown columns are ignored."""
    for column, values in filters.items():
        values = list(values or [])
        if column in df.columns and values:
            df = df.filter(F.col(f"`{column}`").isin(values))
    return df


def top_n(df: DataFrame, sort_column: str, n: int, ascending: bool = False,
          tiebreak: list[str] | None = None) -> DataFrame:
    """Sorted head (TakeOrderedAndProject: per-partition top-n, then a bounded merge)."""
    if sort_column not in df.columns:
        return df
    key = F.col(f"`{sort_column}`")
    order = key.asc() if ascending else key.desc()
    return df.orderBy(order, *(tiebreak or [])).limit(int(n))


def monthly_sum(df: DataFrame, date_column: str, value_column: str, output_column: str | None = None) -> DataFrame:
    """Calendar-month buckets; non-numeric values count as 0."""
    ts = parse_dates(F.col(f"`{date_column}`"), df.schema[date_column].dataType)
    value = F.coalesce(to_number(F.col(f"`{value_column}`"), df.schema[value_column].dataType), F.lit(0.0))
    out = output_column or value_column
    return (df.select(F.date_trunc("month", ts).alias("period"), value.alias("_v"))
            .filter(F.col("period").isNotNull())
            .groupBy("period").agg(F.round(exact_sum("_v"), 2).alias(out)))


def filter_options(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Sorted distinct non-null values as text (all, or the first ``limit``)."""
    found = df.select(F.col(f"`{column}`").cast("string").alias("value")).filter(F.col("value").isNotNull()).distinct().orderBy("value")
    return found if limit is None else found.limit(int(limit))

"""Distributed order statistics checked against pandas / numpy brute force."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwright.operators.ranking import average_percent_rank, exact_quantiles


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=-5, max_value=20), min_size=1, max_size=60))
def test_average_percent_rank_matches_pandas(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r["v"]: r["p"] for r in average_percent_rank(df, "v", "p").collect()}
    expect = pd.Series(values, dtype=float).rank(method="average", pct=True)
    for v, p in zip(values, expect):
        assert abs(got[float(v)] - p) < 1e-12


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=60))
def test_exact_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    q = exact_quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.98}).collect()[0]
    arr = np.array(values)
    for name, qq in (("a", 0.25), ("b", 0.5), ("c", 0.98)):
        assert abs(q[name] - np.quantile(arr, qq)) <= 1e-6 * max(1.0, abs(np.quantile(arr, qq)))


def test_grouped_quantiles_and_empty_input(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 10.0)], "g string, v double")
    got = {r["g"]: r["m"] for r in exact_quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    assert got == {"x": 2.0, "y": 10.0}
    empty = spark.createDataFrame([], "v double")
    assert exact_quantiles(empty, "v", {"m": 0.5}).collect()[0]["m"] is None


def test_scan_row_ids_count_files_and_rows_without_a_write(spark, tmp_path):
    from pyspark.sql import functions as F

    from sparkwright.sources.readers import with_scan_row_id
    for k, n in enumerate((5, 0, 900, 1)):
        spark.range(n).select(F.lit(k).alias("k"), "id").coalesce(1).write.parquet(str(tmp_path / f"t/part={k}"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = with_scan_row_id(spark.read.parquet(str(tmp_path / "t")), "rid")
        plan = df._jdf.queryExecution().toString().lower()
        got = [(r["rid"], r["k"], r["id"]) for r in df.orderBy("rid").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[0] for r in got] == list(range(906)) and [r[1:] for r in got] == sorted(r[1:] for r in got)
    assert "rangepartitioning" not in plan and "insertinto" not in plan

"""Radix selection: keys that sort like doubles, quantiles by counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.operators.ranking import exact_quantiles, key_value, order_key


def test_keys_sort_like_doubles_and_come_back(spark):
    g = np.random.default_rng(0)
    x = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"),
         1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 0), 2.0, np.nextafter(2.0, 0), 0.1, -0.1, 1e-310]
    x += [float(2.0 ** k) for k in range(-1074, 1024, 37)] + [float(np.nextafter(2.0 ** k, 0)) for k in range(-1000, 1024, 53)]
    x += g.integers(0, 1 << 63, 2000).view(np.float64).tolist() + (-g.exponential(size=500)).tolist()
    x = [float(v) for v in x if v == v]
    df = spark.createDataFrame([(v,) for v in x], "v double").select("v", order_key(F.col("v")).alias("k"))
    rows = df.select("v", "k", key_value(F.col("k")).alias("b")).collect()
    assert all(r["v"] == r["b"] for r in rows)
    rows.sort(key=lambda r: r["v"])
    assert all((a["k"] < b["k"]) == (a["v"] < b["v"]) for a, b in zip(rows, rows[1:]))
    nan = spark.createDataFrame([(float("nan"),)], "v double").select(order_key(F.col("v")).alias("k")).first()["k"]
    assert nan > max(r["k"] for r in rows)


@pytest.mark.parametrize("kind", ["normal", "few", "wide", "one"])
def test_quantiles_like_numpy(spark, kind):
    g = np.random.default_rng(3)
    x = {"normal": g.normal(size=700), "few": g.integers(-2, 3, 700).astype(float), "wide": g.normal(size=701) * 10.0 ** g.integers(-200, 200, 701), "one": np.array([7.5])}[kind]
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", float(v)) for v in x[:31]] + [("b", None)], "g string, v double")
    qs = {"lo": 0.0, "q": 0.25, "m": 0.5, "h": 0.98, "hi": 1.0}
    got = {r["g"]: r for r in exact_quantiles(df, "v", qs, ["g"]).collect()}
    for name, part in (("a", x), ("b", x[:31])):
        want = np.quantile(part, list(qs.values()))
        assert np.allclose([got[name][n] for n in qs], want, rtol=1e-12, atol=0)


def test_weights_stand_for_rows_and_nothing_is_written(spark):
    df = spark.createDataFrame([(float(v), v % 4) for v in range(200)], "v double, n int")
    rows = df.select("v", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).where("n > 0")
    plan = exact_quantiles(df.where("n > 0"), "v", {"m": 0.5, "h": 0.9}, weight_col="n")
    assert plan.first() == exact_quantiles(rows, "v", {"m": 0.5, "h": 0.9}).first()
    text = plan._jdf.queryExecution().toString()
    assert "RangePartitioning" not in text and "rangepartitioning" not in text and "parquet" not in text
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()  # the source is counted once

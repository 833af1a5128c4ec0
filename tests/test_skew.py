"""Hot keys: one value holds a third of the rows. Results must stay exact."""

import numpy as np
import pandas as pd

from conftest import rows
from sparkwright.operators import common
from sparkwright.operators.generic import aggregate
from sparkwright.operators.ranking import average_percent_rank, exact_quantiles, with_row_id


def _skewed(n=900, seed=7):
    rng = np.random.default_rng(seed)
    hot = n // 3
    key = np.concatenate([np.zeros(hot, dtype=int), rng.integers(1, 60, n - hot)])
    val = np.concatenate([np.full(hot, 5.0), rng.normal(10, 3, n - hot).round(2)])
    return pd.DataFrame({"rid": np.arange(n), "k": key, "v": val})


def _expected_dup_flags(pdf):
    return pdf.sort_values("rid").duplicated(subset=["k", "v"], keep="first").tolist()


def test_duplicate_flags_hot_group_broadcast_and_shuffle(spark):
    pdf = _skewed()
    df = spark.createDataFrame(pdf)
    expect = _expected_dup_flags(pdf)
    got = [r["is_duplicate_row"] for r in rows(common.flag_duplicates(df, ["k", "v"], ["rid"]).orderBy("rid"))]
    assert got == expect
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # force the shuffle join
    got = [r["is_duplicate_row"] for r in rows(common.flag_duplicates(df, ["k", "v"], ["rid"]).orderBy("rid"))]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == expect


def test_ranks_and_quantiles_with_hot_value(spark):
    pdf = _skewed()
    df = spark.createDataFrame(pdf)
    got = {r["v"]: r["p"] for r in rows(average_percent_rank(df, "v", "p"))}
    expect = pdf["v"].rank(method="average", pct=True)
    assert all(abs(got[v] - e) < 1e-12 for v, e in zip(pdf["v"], expect))
    q = rows(exact_quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.98}))[0]
    for name, qq in (("a", 0.1), ("b", 0.5), ("c", 0.98)):
        assert abs(q[name] - np.quantile(pdf["v"], qq)) < 1e-9


def test_row_ids_and_aggregate_with_hot_key(spark):
    pdf = _skewed()
    df = spark.createDataFrame(pdf)
    ids = rows(with_row_id(df, ["k", "rid"], "row_id").orderBy("k", "rid"))
    assert [r["row_id"] for r in ids] == list(range(len(pdf)))
    agg = {r["k"]: (r["v"], r["rows"]) for r in rows(aggregate(df.withColumn("k", df.k.cast("string")), "v", "sum", "k"))}
    exp = pdf.groupby("k")["v"].agg(["sum", "size"])
    for k, (s, n) in exp.iterrows():
        assert agg[str(k)][1] == n and abs(agg[str(k)][0] - round(s, 2)) < 1e-9

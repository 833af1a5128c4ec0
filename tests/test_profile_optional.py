"""Opt-in profiles: sketches per file, fingerprints across loads, scatter sample."""

import os

import pytest
from pyspark.sql import functions as F

from sparkwright.operators import loads, sketches
from sparkwright.operators.profile import fingerprint, scatter_sample
from sparkwright.sources.sinks import read_written, write_table
from tests.conftest import one, rows


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sketched"))
    df = spark.range(40000).selectExpr("id % 9000 as k", "cast(pow(id % 1000, 2) as double) as v", "if(id % 3 = 0, 'hot', concat('s', id % 700)) as s", "cast(null as string) as none")
    df.repartition(6).write.parquet(os.path.join(path, "t"))
    return os.path.join(path, "t")


def test_sketches_of_files_merge_like_the_whole(spark, files, tmp_path):
    df = spark.read.parquet(files)
    per_file = sketches.sketch(df, ["k", "v"], ["s", "none"])
    assert per_file.select("part").distinct().count() == 6
    write_table(per_file, str(tmp_path / "s"))
    got = {r["column"]: r for r in rows(sketches.profile(sketches.merge(read_written(spark, str(tmp_path / "s")))))}
    assert {r["rows"] for r in got.values()} == {40000}
    assert abs(got["k"]["unique_values"] - 9000) <= sketches.UNIQUE_ERROR * 9000
    for name, p in sketches.QUANTILES.items():
        assert (p - sketches.RANK_ERROR) * 1000 <= got["v"][name] ** 0.5 <= (p + sketches.RANK_ERROR) * 1000
    assert got["s"]["most_common"] == "hot" and abs(got["s"]["most_common_count"] - 13334) <= sketches.COUNT_ERROR * 40000
    assert (got["none"]["present"], got["none"]["unique_values"], got["none"]["most_common"]) == (0, 0, None)


def test_values_outside_the_bound_are_told(spark, files):
    df = spark.read.parquet(files)
    right = sketches.profile(sketches.merge(sketches.sketch(df, ["k"], ["s"])))
    wrong = right.withColumns({"unique_values": F.col("unique_values") * 2, "median": F.col("median") + 900, "most_common": F.when(F.col("most_common").isNotNull(), F.lit("s7"))})
    good, bad = ({r["column"]: r for r in rows(sketches.beside_exact(df, a, ["k", "s"]))} for a in (right, wrong))
    assert good["k"]["unique_in_bound"] and good["k"]["quantiles_in_bound"] and good["s"]["common_in_bound"]
    assert not bad["k"]["unique_in_bound"] and not bad["k"]["quantiles_in_bound"] and not bad["s"]["common_in_bound"]


def test_numbers_alone_and_an_empty_table(spark, files):
    df = spark.read.parquet(files)
    assert one(sketches.profile(sketches.merge(sketches.sketch(df, ["k"], []))))["most_common"] is None
    assert sketches.profile(sketches.merge(sketches.sketch(df.where("k < 0"), ["k"], ["s"]))).count() == 0


def test_loads_hash_only_what_is_new(spark, tmp_path):
    a, b, c, empty, folder = (str(tmp_path / n) for n in ("a", "b", "c", "e", "marks"))
    df = spark.range(500).selectExpr("id", "cast(id % 7 as string) as s").union(spark.sql("select 3L, '3'"))
    df.repartition(3).write.parquet(a)
    df.orderBy(F.desc("id")).coalesce(1).write.parquet(b)
    df.withColumn("s", F.when(F.col("id") == 9, "x").otherwise(F.col("s"))).coalesce(1).write.parquet(c)
    df.where("id < 0").coalesce(1).write.parquet(empty)
    _, n = loads.load(spark, folder, {"a": a})
    assert n == 3
    found, n = loads.load(spark, folder, {"a": a, "b": b, "c": c, "e": empty})
    got = {r["name"]: r for r in rows(found)}
    assert n == 3  # b, c and the file without rows
    assert {k: r["same_as"] for k, r in got.items()} == {"a": None, "b": "a", "c": None, "e": None}
    assert got["a"]["row_count"] == 501 and got["e"]["row_count"] == 0
    whole = one(fingerprint(spark.read.parquet(a)))
    assert {k: got["a"][k] for k in whole} == whole
    df.limit(5).write.mode("append").parquet(b)
    found, n = loads.load(spark, folder, {"a": a, "b": b})
    got = {r["name"]: r for r in rows(found)}
    assert set(got) == {"a", "b"} and got["b"]["same_as"] is None and got["b"]["row_count"] == 506


def test_scatter_sample_depends_on_values_alone(spark):
    df = spark.range(6000).selectExpr("cast(if(id % 3 = 0, 1, id % 97) as double) as `x y`", "cast(if(id % 3 = 0, 1, pow(id % 89, 2)) as double) as b", "id")
    df = df.union(spark.sql("select 1e6, 1e6, 0L")).union(spark.sql("select double('infinity'), 1D, 0L")).union(spark.sql("select cast(null as double), 1D, 0L"))
    def take(d):
        return sorted(tuple(r) for r in scatter_sample(d, "x y", "b", bins=10, per_bin=7).collect())
    got = take(df)
    assert got == take(df.repartition(7, "id")) == take(df.orderBy(F.desc("id")).coalesce(1))
    cells = {}
    for *_, i, j, n in got:
        cells.setdefault((i, j, n), []).append(1)
    assert sum(n for _, _, n in cells) == 6001 and all(len(v) == min(7, k[2]) for k, v in cells.items())
    assert (1e6, 1e6, 9, 9, 1) in got
    assert scatter_sample(df.where("id < 0"), "x y", "b").count() == 0
    assert {tuple(r)[2:] for r in scatter_sample(spark.sql("select 2D as a, 3D as b"), "a", "b").collect()} == {(0, 0, 1)}

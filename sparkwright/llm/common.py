"""Helpers shared by the training-data operators: table reads, lineage cuts, components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.session import scratch_root


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage: a lost executor re-reads files, nothing is recomputed. The folder is
    marked for removal when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/llm-stage/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = hpath
    return out


def release(*staged: DataFrame) -> None:
    """Remove the files of staged tables that no result needs any more."""
    for df in staged:
        df._folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(df._folder, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64 arrays."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Distributed union-find: (node, component) for every node of ``edges(a, b)`` (longs).

    Contraction rounds on DataFrames: each vertex points at its neighbour (or itself) with
    the least seeded hash, edges are relabelled by one pointer step, loops and repeats go.
    The hash is new in every round, so long paths shrink by a constant share per round.
    ``component`` is the smallest node of the component. Hot vertices meet only map-side
    combined minima and joins against a table that has one row per vertex.
    Nothing but the count of remaining edges reaches the driver.
    """
    both = edges.where("a is not null and b is not null")
    e = stage(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = both.select(F.col("a").alias("node")).union(both.select(F.col("b").alias("node"))).distinct()
    label = stage(nodes.select("node", F.col("node").alias("rep")), "nodes")
    for r in range(max_rounds):
        if e.isEmpty():
            break
        h = lambda c: F.struct(F.xxhash64(F.lit(r), c).alias("h"), c.alias("v"))
        two = e.select(F.col("a").alias("u"), F.col("b").alias("w")).union(e.select(F.col("b"), F.col("a")))
        ptr = two.groupBy("u").agg(F.min(h(F.col("w"))).alias("m")).select(
            "u", F.least(F.col("m"), h(F.col("u")))["v"].alias("p"))
        ptr = stage(ptr, "ptr")
        old = e, label
        label = stage(label.join(ptr, label["rep"] == ptr["u"], "left").select("node", F.coalesce("p", "rep").alias("rep")), "label")
        pa, pb = ptr.select(F.col("u").alias("a"), F.col("p").alias("pa")), ptr.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        e = stage(e.join(pa, "a").join(pb, "b").where("pa <> pb").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        release(ptr, *old)
    else:
        raise RuntimeError("components did not settle")
    release(e)
    low = label.groupBy("rep").agg(F.min("node").alias("component"))
    return label.join(low, "rep").select("node", "component")



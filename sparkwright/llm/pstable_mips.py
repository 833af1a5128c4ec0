"""Approximate nearest neighbours by multiprobe p-stable hashing, for the largest inner product.

Vectors are scaled by the largest norm and get one more coordinate, sqrt(1 - |x|^2); queries
are scaled to length one and get 0. Euclidean order is then the order of inner products.
Each of ``TABLES`` tables hashes a vector with ``FUNCTIONS`` functions floor((a.x + b) / WIDTH),
a Gaussian. A query visits the cells around its own in the order of estimated success: the
least sum of squared distances from its projections to the cell. The number of visits is the
smallest of a doubling series that finds ``TARGET`` of the true neighbours of a bounded,
seeded sample of ``SAMPLE`` vectors within that sample (in the whole table neighbours are
nearer, so recall there is higher). Visits reach as many cells away as that takes: vectors of
length one span a bounded number of cells, so the series ends with all of them. Every vector
is indexed. Vectors of different lengths have no inner product: each length is searched by itself.

Equal vectors are one entry, with the ``k + 1`` least ids. A cell is worked on in blocks of
at most ``_BLOCK`` entries and ``_BLOCK`` queries (hot cells are dealt out over tasks); a
block scores its pairs with one product and returns each query's best ``k + 1``; these are
scored again on the original vectors in a fixed order of summation and merged.

Defined cases: null, zero-length, zero and non-finite vectors, vectors with null components
and null ids take no part; the candidates of a query are the vectors of its own length; a
query with fewer candidates found returns those; rows with the
query's own id are never its candidates; ties in score go to the smaller id; rows that
agree in id and vector are one candidate, and repeated query rows give one answer; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm.common import read, stage

K = 20
TABLES, FUNCTIONS, WIDTH, REACH = 2, 4, 1.5, 2  # REACH: cells away at first, widened where the target asks for it
SAMPLE, SAMPLE_QUERIES, TARGET = 4000, 100, 0.97
_BLOCK = 4096
_COSTS = 1_000_000         # visit costs of a task at a time
_SEED = 11


class Hashes:
    def __init__(self, dim: int, norm: float, reach: int = REACH):
        g = np.random.default_rng(_SEED)
        self.norm = norm
        self.a, self.b = g.normal(size=(TABLES, dim + 1, FUNCTIONS)), g.uniform(0, WIDTH, size=(TABLES, FUNCTIONS))
        self.reach = reach
        self.steps = np.array(list(itertools.product(range(-reach, reach + 1), repeat=FUNCTIONS)), np.int64)
        # two points of length one lie no further apart in any projection
        self.span = int(2 * np.linalg.norm(self.a, axis=1).max() / WIDTH) + 1
        self.place = 1 << (12 * np.arange(FUNCTIONS, dtype=np.int64))

    def _project(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.a[table] + self.b[table]) / WIDTH

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        x = x / self.norm
        more = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
        return ((np.floor(self._project(np.c_[x, more], table)).astype(np.int64) + 2048) * self.place).sum(1)

    def probes(self, q: np.ndarray, table: int, visits: int) -> np.ndarray:
        """Cells per query, likeliest first."""
        at = self._project(np.c_[q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))], table)
        own = np.floor(at)
        inside, cost = at - own, np.zeros((len(q), len(self.steps)))
        for f in range(FUNCTIONS):
            s = self.steps[:, f]
            gap = np.where(s > 0, s - inside[:, [f]], np.where(s < 0, inside[:, [f]] - s - 1, 0))
            cost += gap * gap
        order = np.argsort(cost, axis=1, kind="stable")[:, :visits]
        return ((own.astype(np.int64)[:, None, :] + self.steps[order] + 2048) * self.place).sum(2)


def choose_visits(x: np.ndarray, norm: float, k: int = K, first: int = REACH) -> tuple[Hashes, int]:
    """Hashes and the smallest doubling number of visits per table that reach TARGET recall inside the sample."""
    q = x[:SAMPLE_QUERIES]
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    true = np.argsort(-score, axis=1, kind="stable")[:, :min(k, max(len(x) - 1, 1))]
    hashes, visits = Hashes(x.shape[1], norm, first), 16
    cells = [hashes.cells(x, t) for t in range(TABLES)]
    while True:
        visits = min(visits, len(hashes.steps))
        hit = np.zeros(true.shape, bool)
        for t in range(TABLES):
            for i in range(len(q)):
                hit[i] |= np.isin(cells[t][true[i]], hashes.probes(q[i:i + 1], t, visits)[0])
        if hit.mean() >= TARGET or (visits == len(hashes.steps) and hashes.reach >= hashes.span):
            return hashes, visits
        if visits == len(hashes.steps):
            hashes = Hashes(x.shape[1], norm, hashes.reach + 1)
        visits *= 2


def _best(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of y, rows of x) of every product at or above the row's k-th best, within rounding."""
    scores = y @ x.T
    if scores.shape[1] <= k:
        return np.nonzero(np.ones(scores.shape, bool))
    slack = 4 * x.shape[1] * np.finfo(scores.dtype).eps * np.linalg.norm(y, axis=1) * np.linalg.norm(x, axis=1).max()
    return np.nonzero(scores >= (np.partition(scores, -k, axis=1)[:, -k] - slack)[:, None])


def _block(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d, q = pdf[~pdf["query"]], pdf[pdf["query"]]
        if not len(d) or not len(q):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("q1", "q2", "c1", "c2")} | {"score": np.zeros(0), "low": np.zeros(0, np.int64)})
        x, y, low = np.stack(d["v"].to_numpy()), np.stack(q["v"].to_numpy()), d["low"].to_numpy()
        out = []
        for lo in range(0, len(y), 256):
            i, j = _best(x, y[lo:lo + 256], k)
            i = i + lo
            exact = (y[i] * x[j]).sum(-1)
            order = np.lexsort((low[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            keep = rank < k
            out.append((i[keep], j[keep], exact[keep]))
        i, j, s = (np.concatenate([o[n] for o in out]) for n in range(3))
        return pd.DataFrame({"q1": q["k1"].to_numpy()[i], "q2": q["k2"].to_numpy()[i], "c1": d["k1"].to_numpy()[j], "c2": d["k2"].to_numpy()[j],
                             "score": s, "low": low[j]})
    return run


def _cell_rows(hashes: Hashes, visits: int):
    """Entries -> one row per table; with ``visits``, as queries, one row per visit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, min(1000, _COSTS // len(hashes.steps) if visits else 1000))
            for lo in range(0, b.num_rows, step):
                s = b.slice(lo, step)
                x = np.stack(s.column(2).to_numpy(zero_copy_only=False))
                for t in range(TABLES):
                    cells = hashes.probes(x, t, visits) if visits else hashes.cells(x, t)[:, None]
                    at = pa.array(np.repeat(np.arange(len(x)), cells.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(cells.size, t, np.int32)), pa.array(cells.ravel()),
                                                      *(s.column(i).take(at) for i in range(4))], ["t", "cell", "k1", "k2", "v", "low"])
    return run


def _least_ids(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pdf = b.to_pandas().sort_values("vec_id")
            g = pdf.groupby(["k1", "k2"], sort=False)
            first = g["v"].first().reset_index()
            ids = g["vec_id"].apply(lambda s: s.unique()[:k + 1].tolist()).reset_index()
            yield pa.RecordBatch.from_arrays([pa.array(first["k1"]), pa.array(first["k2"]), pa.array(first["v"], pa.list_(pa.float64())),
                                              pa.array(ids["vec_id"], pa.list_(pa.int64()))], ["k1", "k2", "v", "ids"])
    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors`` has vec_id and embedding; ``queries`` has vec_id: rows of it that ask."""
    result = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    rows = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(7), F.col("v"))})
    lengths = sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect())  # a few, whatever the rows
    if not lengths:
        return vectors.sparkSession.createDataFrame([], result)
    return functools.reduce(DataFrame.union, (_search(rows.where(F.size("v") == d), queries, k) for d in lengths))


def _search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The answers among rows (vec_id, v, k1, k2) of one length."""
    per_batch = rows.select("k1", "k2", "v", "vec_id").mapInArrow(_least_ids(k), "k1 long, k2 long, v array<double>, ids array<long>")
    few = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    parts = per_batch.withColumn("salt", F.spark_partition_id() % 256).groupBy("k1", "k2", "salt").agg(F.first("v").alias("v"), few)
    asks = rows.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi").select(
        F.col("vec_id").alias("query_id"), "k1", "k2").distinct()
    entries = stage(parts.groupBy("k1", "k2").agg(F.first("v").alias("v"), few).withColumn("low", F.col("ids")[0]), "entries")
    asks = stage(asks, "asks")

    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    norm = entries.agg(F.max(size).alias("m")).first()["m"]
    some = entries.orderBy("k1", "k2").limit(SAMPLE).select("v").collect()  # bounded by SAMPLE
    hashes, visits = choose_visits(np.array([r["v"] for r in some]), norm, k)

    types = "t int, cell long, k1 long, k2 long, v array<double>, low long"
    cut = ["k1", "k2", "v", "low"]
    data = entries.select(*cut).mapInArrow(_cell_rows(hashes, 0), types)
    asked = entries.join(asks.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select(*cut).mapInArrow(_cell_rows(hashes, visits), types)
    blocks = lambda df, name: df.groupBy("t", "cell").agg(F.ceil(F.count("*") / F.lit(_BLOCK)).cast("int").alias(name))
    cells = stage(blocks(data, "nd").join(blocks(asked, "nq"), ["t", "cell"]), "cells")
    deal = lambda n: F.pmod(F.xxhash64("k1", F.col("k2")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    d = data.join(cells, ["t", "cell"]).withColumns({"db": deal("nd"), "qb": every("nq")}).withColumn("query", F.lit(False))
    q = asked.join(cells, ["t", "cell"]).withColumns({"db": every("nd"), "qb": deal("nq")}).withColumn("query", F.lit(True))
    found = d.union(q).groupBy("t", "cell", "db", "qb").applyInPandas(
        _block(k + 1), "q1 long, q2 long, c1 long, c2 long, score double, low long").distinct()

    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "low")
    near = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    listed = near.join(entries.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "ids"), ["c1", "c2"]).select(
        "q1", "q2", "score", F.explode("ids").alias("vec_id"))
    top = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    answers = asks.join(listed.withColumnsRenamed({"q1": "k1", "q2": "k2"}), ["k1", "k2"]).where("vec_id <> query_id")
    per_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(per_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES = {"op3_ann": op3_ann}

"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms of a text are its hashed byte trigrams and a few surface terms (repeated words,
repeated lines, capital words, words of letters only). A bounded sample of labelled
documents (``SAMPLE`` rows, least hashes of the id, folds 1-4 of crc32) gives term weights
(square root of the count times inverse document frequency), a truncated singular value
decomposition of the weighted matrix, and the labelled latent vectors. Model and vectors
are broadcast; their size is fixed by the parameters (under 3 MB). Every document of the
table is projected and compared with all labelled vectors in blocks (exact cosines); the
``NEIGHBOURS`` nearest vote with weight ``cosine ** POWER``.

Defined cases: null and empty texts, and texts without any positive cosine, get the share
of label 1 in the sample; without usable labels every score is 0.5; labels other than 0
and 1 and null ids are not learnt from; rows are scored one by one, so repeated rows score
alike; ties in nearness go to the earlier sample row; an empty table gives an empty result;
other columns are ignored by ``score`` and kept by ``keep_good``. Whole texts are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import read

SAMPLE, DIMS, NEIGHBOURS, POWER, THRESHOLD = 4000, 32, 7, 4, 0.3
_HASHED = 4096
_TERMS = _HASHED + 6


def terms(text: str | None) -> np.ndarray:
    """Term counts of one whole text."""
    v = np.zeros(_TERMS, np.float32)
    if not text:
        return v
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    for lo in range(0, max(len(b) - 2, 0), 1 << 20):  # bounded memory for very long texts
        a = b[lo:lo + (1 << 20) + 2].astype(np.uint32)
        h = ((a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)) >> np.uint32(20)
        v[:_HASHED] += np.bincount(h, minlength=_HASHED)
    words, lines = text.split(), text.split("\n")
    v[_HASHED:] = (sum(map(str.__eq__, words, words[1:])), len(words) - len(set(words)), len(lines) - len(set(lines)),
                   sum(map(str.isupper, words)), len(words), sum(map(str.isalpha, words)))
    return v


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    idf: np.ndarray       # per term
    axes: np.ndarray      # terms x dims
    vectors: np.ndarray   # labelled latent vectors, unit length
    labels: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(np.sqrt(counts) * self.idf) @ self.axes)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for lo in range(0, len(texts), 256):
            z = self.latent(np.array([terms(t) for t in texts[lo:lo + 256]]))
            cos = z @ self.vectors.T
            near = np.argsort(-cos, axis=1, kind="stable")[:, :k] if k == len(self.labels) else _top(cos, k)
            w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(float) ** POWER
            total = w.sum(1)
            out[lo:lo + 256] = np.where(total > 0, (w * self.labels[near]).sum(1) / np.where(total > 0, total, 1), self.labels.mean())
        return np.clip(out, 0, 1)


def _top(cos: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values per row, ties to the smaller column."""
    edge = np.partition(cos, -k, axis=1)[:, -k][:, None]
    rank = np.where(cos > edge, 2, (cos == edge).astype(np.int8))
    # all above the edge, then the first ones at the edge
    pick = (rank == 2) | ((rank == 1) & (np.cumsum(rank == 1, axis=1) <= k - (rank == 2).sum(1, keepdims=True)))
    return np.nonzero(pick)[1].reshape(len(cos), k)


def fit_arrays(counts: np.ndarray, labels: np.ndarray, dims: int = DIMS) -> Model:
    """The model of a sample's term counts, which are left as they are."""
    return _fit_roots(np.sqrt(counts, dtype=np.float32), labels, dims)


def _fit_roots(x: np.ndarray, labels: np.ndarray, dims: int = DIMS) -> Model:
    """Randomised truncated SVD (seeded) of the weighted sample; ``x``, the square roots of the counts, is weighted in place."""
    labels = labels.astype(float)
    if not len(labels):
        return Model(np.ones(_TERMS, np.float32), np.zeros((_TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    idf = (np.log((1 + len(labels)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    for lo in range(0, len(x), 256):  # the driver holds this matrix once
        x[lo:lo + 256] = _unit(x[lo:lo + 256] * idf)
    g = np.random.default_rng(0).normal(size=(x.shape[1], dims + 16)).astype(np.float32)
    for _ in range(3):
        g = np.linalg.qr(x.T @ (x @ g))[0]
    axes = np.ascontiguousarray((np.linalg.svd(x @ g, full_matrices=False)[2][:dims] @ g.T).T, np.float32)
    return Model(idf, axes, _unit(x @ axes), labels)


def fold(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def _sparse_terms(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        v = terms(t)
        at = np.flatnonzero(v)
        out.append((at.astype("<u2").tobytes(), v[at].astype("<f4").tobytes()))
    return pd.DataFrame(out, columns=["at", "n"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows outside fold 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        "doc_id is not null and label in (0, 1)").where(fold("doc_id") != 0)
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(some), "doc_id").select("doc_id", "label", F.pandas_udf(_sparse_terms, "at binary, n binary")("text").alias("v")).select("doc_id", "label", "v.*")
    # at most `sample` rows, also where an id stands on several documents
    rows = rows.orderBy("doc_id", "label", "at", "n").limit(sample).collect()
    roots, found = np.zeros((len(rows), _TERMS), np.float32), np.array([r["label"] for r in rows])
    for i, r in enumerate(rows):
        roots[i, np.frombuffer(r["at"], "<u2")] = np.sqrt(np.frombuffer(r["n"], "<f4"))
    del rows
    return _fit_roots(roots, found)


def score_column(docs: DataFrame, model: Model) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()))

    return score(docs["text"].cast("string"))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(docs, fit(docs, labels)).alias("score"))
    return s.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    return docs.where(score_column(docs, fit(docs, labels)) >= threshold)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op1_quality": op1_quality}

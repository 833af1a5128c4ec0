"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every word (white-space separated, lower case, outer marks cut off) enters as a word vector
(hashed vocabulary) beside the mean of its character-trigram vectors (hashed). Two gated
recurrent passes read windows of ``WINDOW`` words, attention pools the states, a logistic
unit scores the window. Windows start every ``STRIDE`` words and cover the whole text; a
document scores as its most toxic window.

Training (driver, numpy, fixed seeds) uses a bounded sample of labelled documents outside
fold 0: at most ``SAMPLE`` rows per label, least id hashes, texts up to ``TRAIN_CHARS``
characters, all their windows; the gradient goes through the document's highest window.
The fitted parameters (about 1.5 MB, fixed) are broadcast; scoring reads every whole text.

Defined cases: null, empty and blank texts have no words and score as one empty window, i.e.
the network's bias; without labels of both kinds every score is the share of label 1, or
0 without any; rows are scored one by one; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import read

WINDOW, STRIDE = 64, 48
SAMPLE, TRAIN_CHARS = 1200, 20_000
EMBED, HIDDEN, ATTEND = 8, 8, 8
_WORDS, _TRIGRAMS = 1 << 15, 1 << 12
_CACHE_WORDS = 300_000
_MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: hashed id; hashed trigrams of all words in a row; where each word's begin."""
    raw = [b"^" + w.strip(_MARKS).encode("utf-8", "surrogatepass") + b"$$" for w in words]
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    begin = np.cumsum(n) - n
    tri = b.copy()
    tri[:-2] = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    at = np.arange(len(b)) - np.repeat(begin, n)
    inside = at < np.repeat(n - 2, n)  # trigrams that stay in the word
    with np.errstate(over="ignore"):
        power = (np.uint32(2654435761) ** (at.astype(np.uint32) % np.uint32(64)))
        ids = np.add.reduceat((b + np.uint32(1)) * power, begin, dtype=np.uint32) if len(raw) else np.zeros(0, np.uint32)
        ids = (ids * np.uint32(2246822519)) >> np.uint32(32 - 15)
        tri = (tri * np.uint32(2654435761)) >> np.uint32(32 - 12)
    return ids.astype(np.int64), tri[inside].astype(np.int64), np.cumsum(n - 2) - (n - 2)


def windows(n_words: int, size: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """First words of the windows that cover ``n_words`` words."""
    return np.arange(0, max(n_words - size, 0) + stride, stride) if n_words > size else np.zeros(1, np.int64)


def init(seed: int = 0) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    r = lambda *s, scale=1.0: (g.normal(size=s) * scale).astype(np.float32)
    p = {"ew": r(_WORDS, EMBED, scale=0.3), "ec": r(_TRIGRAMS, EMBED, scale=0.3), "wa": r(2 * HIDDEN, ATTEND, scale=0.3),
         "v": r(ATTEND, scale=0.3), "wo": r(2 * HIDDEN, scale=0.3), "bo": np.full(1, -1, np.float32)}
    for d in "fb":
        p |= {f"wx{d}": r(2 * EMBED, 3 * HIDDEN, scale=0.4), f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": r(HIDDEN, 3 * HIDDEN, scale=0.3)}
    return p


def inputs(p: dict, words: list[str]) -> np.ndarray:
    """Input vector per distinct word; row 0 is the padding."""
    x = np.zeros((len(words) + 1, 2 * EMBED), np.float32)
    if words:
        ids, tri, begin = word_inputs(words)
        n = np.diff(begin, append=len(tri))
        x[1:, :EMBED] = p["ew"][ids]
        x[1:, EMBED:] = np.add.reduceat(p["ec"][tri], begin) / n[:, None]
    return x


def _gru(gates: np.ndarray, ids: np.ndarray, u: np.ndarray, order, keep: list | None, out: np.ndarray) -> None:
    """One pass over windows ``ids`` (n x size; 0 is padding); states go to ``out`` (size x n x hidden)."""
    h = np.zeros((ids.shape[0], HIDDEN), np.float32)
    for t in order:
        now = ids[:, t]
        x, hu = gates[now], h @ u
        zr = np.tanh((x[:, :2 * HIDDEN] + hu[:, :2 * HIDDEN]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN:] + r * hu[:, 2 * HIDDEN:])
        new = c + z * (h - c)
        real = (now > 0)[:, None]
        if keep is not None:
            keep.append((t, h, z, r, c, hu[:, 2 * HIDDEN:], real))
        h = np.where(real, new, h)
        out[t] = h


def forward(p: dict, gates: dict, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit per window. gates: per direction, input part of the gates by word."""
    n, size = ids.shape
    hs = np.empty((size, n, 2 * HIDDEN), np.float32)
    for d, order, at in (("f", range(size), slice(0, HIDDEN)), ("b", range(size - 1, -1, -1), slice(HIDDEN, None))):
        steps = [] if keep is not None else None
        _gru(gates[d], ids, p[f"u{d}"], order, steps, hs[:, :, at])
        if keep is not None:
            keep[d] = steps
    a = np.tanh(hs.reshape(-1, 2 * HIDDEN) @ p["wa"])
    e = (a @ p["v"]).reshape(size, n)
    e = np.where(ids.T > 0, e, np.float32(-1e9))
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    pooled = np.einsum("tn,tnh->nh", w, hs)
    pooled[ids[:, 0] == 0] = 0  # no word at all
    if keep is not None:
        keep.update(hs=hs, a=a.reshape(size, n, -1), w=w, pooled=pooled)
    return pooled @ p["wo"] + p["bo"][0]


def gate_inputs(p: dict, x: np.ndarray) -> dict:
    return {d: x @ p[f"wx{d}"] + p[f"b{d}"] for d in "fb"}


def backward(p: dict, x: np.ndarray, words: list[str], ids: np.ndarray, keep: dict, dlogit: np.ndarray) -> dict:
    """Gradients of ``sum(dlogit * logit)`` for windows of documents that have words."""
    g = {k: np.zeros_like(v) for k, v in p.items()}
    hs, a, w, pooled = (keep[k] for k in ("hs", "a", "w", "pooled"))
    some = (ids[:, 0] > 0).astype(np.float32)
    g["bo"][0], g["wo"] = dlogit.sum(), pooled.T @ dlogit
    dp = (dlogit * some)[:, None] * p["wo"]
    dw = np.einsum("nh,tnh->tn", dp, hs)
    dhs = w[:, :, None] * dp
    de = w * (dw - (w * dw).sum(0))
    g["v"] = np.einsum("tn,tna->a", de, a)
    da = de[:, :, None] * p["v"] * (1 - a * a)
    g["wa"] = np.einsum("tnh,tna->ha", hs, da)
    dhs = dhs + da @ p["wa"].T
    dx = np.zeros_like(x)
    for d, at in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        u, dh = p[f"u{d}"], np.zeros((len(ids), HIDDEN), np.float32)
        dgates = np.zeros((len(x), 3 * HIDDEN), np.float32)
        for t, h, z, r, c, hc, real in reversed(keep[d]):
            dh = dh + dhs[t][:, at]
            dn = np.where(real, dh, 0)
            dz, dc = dn * (h - c) * z * (1 - z), dn * (1 - z) * (1 - c * c)
            dr = dc * hc * r * (1 - r)
            dhu = np.concatenate([dz, dr, dc * r], 1)
            np.add.at(dgates, ids[:, t], np.concatenate([dz, dr, dc], 1))
            g[f"u{d}"] += h.T @ dhu
            dh = np.where(real, dn * z, dh) + dhu @ u.T
        dgates[0] = 0
        g[f"b{d}"], g[f"wx{d}"] = dgates.sum(0), x.T @ dgates
        dx += dgates @ p[f"wx{d}"].T
    wid, tri, begin = word_inputs(words)
    n = np.diff(begin, append=len(tri))
    np.add.at(g["ew"], wid, dx[1:, :EMBED])
    np.add.at(g["ec"], tri, np.repeat(dx[1:, EMBED:] / n[:, None], n, axis=0))
    return g


def window_ids(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW) of word rows, and the document of each window."""
    starts = [windows(len(d)) for d in docs]
    owner = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
    n = np.array([len(d) for d in docs], np.int64)
    flat = np.concatenate([np.asarray(d, np.int64) for d in docs] + [np.zeros(1, np.int64)])
    base = (np.cumsum(n) - n)[owner]
    at = np.concatenate(starts)[:, None] + np.arange(WINDOW)
    inside = at < n[owner][:, None]
    return np.where(inside, flat[np.where(inside, base[:, None] + at, -1)], 0), owner


def train(texts: list[str], labels: np.ndarray, epochs: int = 10, seed: int = 0) -> dict | None:
    """Adam on the logistic loss of each document's highest window."""
    if len(set(labels.tolist())) < 2:
        return None
    p, g = init(seed), np.random.default_rng(seed + 1)
    m, s, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    split = [words_of(t) for t in texts]
    for epoch in range(epochs):
        order = g.permutation(len(texts))
        for lo in range(0, len(order), 64):
            some = order[lo:lo + 64]
            vocab: dict[str, int] = {}
            docs = [[vocab.setdefault(w, len(vocab) + 1) for w in split[i]] for i in some]
            names = list(vocab)
            x = inputs(p, names)
            gates = gate_inputs(p, x)
            ids, owner = window_ids(docs)
            logit = forward(p, gates, ids)
            best = np.lexsort((np.arange(len(owner)), -logit, owner))
            best = best[np.unique(owner[best], return_index=True)[1]]
            keep: dict = {}
            out = forward(p, gates, ids[best], keep)
            err = (1 / (1 + np.exp(-out)) - labels[some]).astype(np.float32) / len(some)
            grad = backward(p, x, names, ids[best], keep, err)
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for k in p:
                m[k] += 0.1 * (grad[k] - m[k])
                s[k] += 0.01 * (grad[k] ** 2 - s[k])
                p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return p


class Scorer:
    """Scores texts; the gate inputs of a word are worked out once per Python worker."""

    def __init__(self, p: dict):
        self.p = p
        self.clear()

    def clear(self):
        self.rows: dict[str, int] = {}
        self.gates = gate_inputs(self.p, inputs(self.p, []))

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for lo in range(0, len(texts), 256):
            split = [words_of(t) for t in texts[lo:lo + 256]]
            if len(self.rows) > _CACHE_WORDS:
                self.clear()
            new = list(set().union(*split).difference(self.rows))
            if new:
                more = gate_inputs(self.p, inputs(self.p, new)[1:])
                first = len(self.rows) + 1
                self.rows.update(zip(new, range(first, first + len(new))))
                self.gates = {d: np.concatenate([self.gates[d], more[d]]) for d in "fb"}
            docs = [list(map(self.rows.__getitem__, w)) for w in split]
            ids, owner = window_ids(docs)
            logit = np.concatenate([forward(self.p, self.gates, ids[i:i + 1024]) for i in range(0, len(ids), 1024)])
            best = np.full(len(split), -np.inf)
            np.maximum.at(best, owner, logit)
            out[lo:lo + 256] = 1 / (1 + np.exp(-best))
        return out


_SCORERS: dict[int, Scorer] = {}  # by broadcast, one per Python worker


def fold(doc_id: str):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """At most ``per_label`` texts of each label outside fold 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        "doc_id is not null and label in (0, 1)").where(fold("doc_id") != 0)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        F.length("text") <= TRAIN_CHARS)
    some = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_label) for v in (1, 0)]
    rows = texts.join(F.broadcast(some[0].union(some[1])), "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", "label", "text")
    found = [r for v in (1, 0) for r in rows.where(F.col("label") == v).orderBy("h", "doc_id", "text").limit(per_label).collect()]
    return [r["text"] for r in found], np.array([r["label"] for r in found], np.float32)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    texts, known = sample(docs, labels)
    p = train(texts, known)
    rate = float(known.mean()) if len(known) else 0.0
    shared = docs.sparkSession.sparkContext.broadcast(p)

    @F.pandas_udf("double")
    def toxicity(column: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series(np.full(len(column), rate))
        if id(shared.value) not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[id(shared.value)] = Scorer(shared.value)
        return pd.Series(_SCORERS[id(shared.value)].score(column.tolist()))

    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), toxicity(F.col("text").cast("string")).alias("score"))
    return s.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op6_toxicity": op6_toxicity}

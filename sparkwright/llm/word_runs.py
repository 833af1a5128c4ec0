"""Runs: maximal periodic stretches of words, by internal pattern matching.

Texts of a batch are one sequence of symbols (a word of one document is another symbol than
the same word of the next, so nothing crosses documents). Prefix doubling orders the suffixes
and names, level by level, the classes of equal windows of 2^k symbols; a class is an interval
of the suffix array. A wavelet tree over the suffix array answers range successor queries:
the least position at or after x among the suffixes of an interval.

A run of smallest period q contains an aligned block of b symbols (b a power of two) together
with the block's copy q further on, for the b with 2b - 1 <= q <= 4b - 2 (b = 4 also serves
the shorter periods, as a run has at least 12 words; its blocks start at every second word).
So for every block the tree is asked for its occurrences in the window of starts that are
2b - 1 to 4b - 2 further on, in pieces of b starts. In such a piece three or more occurrences
form an arithmetic progression whose difference d is the block's period. The stretches of
period d around block and progression give the candidate periods: the distance of their
beginnings, that of their ends, and, where the two stretches touch, the members of the
progression between; inside one stretch no candidate is primitive. One or two occurrences are
candidates themselves. Each candidate is extended both ways by comparing the classes from the
longest window down, kept if it is long enough, and of stretches that agree the smallest
period counts. A document in which no six words in a row stand twice has no run (a run has six
such words at least) and skips the search.

Defined cases: a null text has no words (n = 0), like an empty or blank one; a null doc_id
counts as the empty text; repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored. Texts are read as UTF-8 bytes and split at the six ASCII
white-space bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import read

MIN_LENGTH = 12
_FIRST = 4              # shortest block
_BATCH = 200_000        # words searched together (one longer text is a batch of its own)
_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Windows:
    """Suffix array of a sequence, and for every level k the class of the 2^k symbols from each place on.

    A class is named by the place of its first suffix in the suffix array. Levels end when all
    classes have one member.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        self.levels, self.n = [], n
        key = symbols
        while True:
            ordered = key[order]
            head = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            size = np.diff(np.r_[head, n])
            rank = np.empty(n, np.int32)
            rank[order] = np.repeat(head, size)
            self.levels.append(rank)
            if len(head) == n:
                break
            step = 1 << (len(self.levels) - 1)
            nxt = np.full(n, -1, np.int64)
            nxt[:-step] = rank[step:]
            key = rank.astype(np.int64) * (n + 1) + nxt + 1
            # only members of larger classes move, each inside its interval
            loose = np.flatnonzero(np.repeat(size > 1, size))
            order[loose] = order[loose][np.argsort(key[order[loose]], kind="stable")]
        self.order = order

    def interval(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array interval of the windows of 2^level symbols that begin at ``at``."""
        rank = self.levels[level]
        lo = rank[at]
        return lo.astype(np.int64), lo + np.bincount(rank, minlength=self.n)[lo]

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols from i and from j on."""
        length = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            a, b, step = i + length, j + length, 1 << level
            ok = (a < self.n) & (b < self.n)
            same = np.zeros(len(i), bool)
            same[ok] = self.levels[level][a[ok]] == self.levels[level][b[ok]]
            length += same * step
        return length

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols before i and before j."""
        length = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            step = 1 << level
            a, b = i - length - step, j - length - step
            ok = (a >= 0) & (b >= 0)
            same = np.zeros(len(i), bool)
            same[ok] = self.levels[level][a[ok]] == self.levels[level][b[ok]]
            length += same * step
        return length


class WaveletTree:
    """Values by their bits, highest first; each level keeps how many zeros stand before every place."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = max(int(top).bit_length(), 1)
        self.zeros, self.split, self.n = [], [], len(values)
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            self.zeros.append(np.r_[0, np.cumsum(~one)].astype(np.int32))
            self.split.append(int(self.zeros[-1][-1]))
            values = np.r_[values[~one], values[one]]

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in [lo, hi) are less than x."""
        count = np.zeros(len(lo), np.int64)
        over = x >> self.bits > 0
        for k, (zeros, split) in enumerate(zip(self.zeros, self.split)):
            one = (x >> (self.bits - 1 - k)) & 1 == 1
            a, b = zeros[lo], zeros[hi]
            count += np.where(one, b - a, 0)
            lo, hi = np.where(one, split + lo - a, a), np.where(one, split + hi - b, b)
        return np.where(over, -1, count)

    def nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least value in [lo, hi)."""
        value = np.zeros(len(lo), np.int64)
        for zeros, split in zip(self.zeros, self.split):
            a, b = zeros[lo], zeros[hi]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            lo, hi = np.where(one, split + lo - a, a), np.where(one, split + hi - b, b)
            value = value * 2 + one
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least value at or above x in [lo, hi), -1 if there is none."""
        before = self.below(lo, hi, x)
        there = (before >= 0) & (before < hi - lo)
        out = np.full(len(lo), -1, np.int64)
        out[there] = self.nth(lo[there], hi[there], before[there])
        return out

    def predecessor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The greatest value below x in [lo, hi), -1 if there is none."""
        before = self.below(lo, hi, x)
        before = np.where(before < 0, hi - lo, before)
        there = before > 0
        out = np.full(len(lo), -1, np.int64)
        out[there] = self.nth(lo[there], hi[there], before[there] - 1)
        return out


def _asked(n: int, levels: int) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """(level, block starts, first and last distance) of all windows, distances in pieces of at most b."""
    level, b = _FIRST.bit_length() - 1, _FIRST
    while level < levels and b <= n:
        starts = np.arange(0, n - b + 1, b // 2 if b == _FIRST else b, dtype=np.int64)
        low, high = (1 if b == _FIRST else 2 * b - 1), 4 * b - 2
        for first in range(low, high + 1, b):
            yield level, starts, first, min(first + b - 1, high)
        level, b = level + 1, b * 2


def _candidates(w: Windows, tree: WaveletTree) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs among which every run of at least MIN_LENGTH has one that lies in it."""
    places, periods = [], []

    def add(place, period):
        places.append(place)
        periods.append(period)

    asked: list[tuple[np.ndarray, ...]] = []
    for level, starts, first, last in _asked(w.n, len(w.levels)):
        lo, hi = w.interval(level, starts)
        some = hi - lo > 1
        at = starts[some]
        asked.append((at, lo[some], hi[some], at + first, at + last + 1))
    if not asked:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, lo, hi, x, end = (np.concatenate([a[k] for a in asked]) for k in range(5))
    f = tree.successor(lo, hi, x)
    ok = (f >= 0) & (f < end)
    at, lo, hi, end, f = at[ok], lo[ok], hi[ok], end[ok], f[ok]
    add(at, f - at)
    s = tree.successor(lo, hi, f + 1)
    ok = (s >= 0) & (s < end)
    at, lo, hi, end, f, s = at[ok], lo[ok], hi[ok], end[ok], f[ok], s[ok]
    add(at, s - at)
    z = tree.predecessor(lo, hi, end)
    ok = z > s
    at, f, d, z = at[ok], f[ok], (s - f)[ok], z[ok]
    # the stretches of period d around the block and around its progression
    x0, y0 = at - w.backward(at, at + d), at + d + w.forward(at, at + d)
    x1, y1 = f - w.backward(f, f + d), f + d + w.forward(f, f + d)
    other = x0 != x1
    at, f, d, z, x0, y0, x1, y1 = (v[other] for v in (at, f, d, z, x0, y0, x1, y1))
    add(at, x1 - x0)
    add(at, y1 - y0)
    touch = np.flatnonzero(y0 >= x1)
    top = np.minimum(np.minimum(np.minimum(y0 - x0, y1 - x1), (y1 - x0) // 2), z - at)[touch]
    n = np.maximum((top - (f - at)[touch]) // d[touch] + 1, 0)
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    add(np.repeat(at[touch], n), np.repeat((f - at)[touch], n) + turn * np.repeat(d[touch], n))
    return np.concatenate(places), np.concatenate(periods)


def find_runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of a sequence, by start and period."""
    none = np.zeros(0, np.int64)
    if len(symbols) < MIN_LENGTH:
        return none, none, none
    w = Windows(symbols)
    place, period = _candidates(w, WaveletTree(w.order.astype(np.int64), w.n))
    fit = (period > 0) & (place + period < w.n)
    place, period = place[fit], period[fit]
    start = place - w.backward(place, place + period)
    length = place + period + w.forward(place, place + period) - start
    long = length >= np.maximum(MIN_LENGTH, 2 * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][:len(start)]  # the smallest period of a stretch
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def planted(words: list[bytes], doc_id: str) -> list[bytes]:
    """The words, from some place on replaced by a repetition where the id's checksum asks for it."""
    n, h = len(words), zlib.crc32(doc_id.encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def repeats(words: list[bytes]) -> bool:
    """Whether six words in a row may stand twice (never false where they do)."""
    if len(words) < MIN_LENGTH:
        return False
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n = len(h) - 5
    grams = h[:n] * _MIX[0]
    for k in range(1, 6):
        grams += h[k:k + n] * _MIX[k]
    grams.sort()
    return bool((grams[1:] == grams[:-1]).any())


def _result(doc_id: int | None, words: list[bytes], start, length, period) -> tuple:
    """The output row of a document."""
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in zip(start.tolist(), length.tolist(), period.tolist()))
    runs = hashlib.sha256(listed.encode()).hexdigest()
    if not len(start):
        return doc_id, 0, None, None, None, None, runs, hashlib.sha256(b" ".join(words)).hexdigest()
    k = np.lexsort((period, start, -length))[0]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = (np.cumsum(edge)[:-1] == 0).tolist()
    collapsed = hashlib.sha256(b" ".join(w for w, keep in zip(words, kept) if keep)).hexdigest()
    best = int(start[k]), int(length[k]), int(period[k])
    return doc_id, len(start), *best, 1000 * best[1] // best[2], runs, collapsed


def _searched(held: list[tuple[int | None, list[bytes]]]) -> Iterator[tuple]:
    """Results of texts whose words are searched as one sequence."""
    names: dict[bytes, int] = {}
    ids = [np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)) for _, words in held]
    size = np.array([len(i) for i in ids])
    cut = np.r_[0, np.cumsum(size)]
    start, length, period = find_runs(np.concatenate(ids) + np.repeat(np.arange(len(ids)), size) * len(names))
    at = np.searchsorted(start, cut)
    for k, (doc_id, words) in enumerate(held):
        own = slice(at[k], at[k + 1])
        yield _result(doc_id, words, start[own] - cut[k], length[own], period[own])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in _SCHEMA.split(", ")])
    none = np.zeros(0, np.int64)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    held: list[tuple[int | None, list[bytes]]] = []
    size = 0
    for b in batches:
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            words = planted((text.as_py() or b"").split(), "" if doc_id is None else str(doc_id))
            if not repeats(words):
                rows.append(_result(doc_id, words, none, none, none))
                continue
            if held and size + len(words) > _BATCH:
                rows += _searched(held)
                held, size = [], 0
            held.append((doc_id, words))
            size += len(words)
        if rows:
            yield out(rows)
    if held:
        yield out(list(_searched(held)))


def runs(docs: DataFrame) -> DataFrame:
    """A row per document with its runs (number, longest, digest) and the digest of the text without repetitions."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_rows, _SCHEMA)


def op11_runs(spark, sf_dir: str) -> DataFrame:
    return runs(read(spark, sf_dir, "documents"))


QUERIES = {"op11_runs": op11_runs}

"""Packing: non-negative least squares over shallow length combinations.

Every document becomes token ids plus an end id. Ids beyond whole windows leave a tail of
1..window-1 ids; whole windows are sequences by themselves. The tails are packed from their
length histogram alone (at most ``window - 1`` counts, whatever the corpus size):

1. enumerate combinations ``m*a + n*b = window`` of at most two lengths that occur;
2. solve repeat counts x >= 0 minimising ``|A x - histogram|`` (accelerated projected gradient);
3. round down, never using more documents than there are;
4. pack the residual histogram greedily, longest first, in bulk: one step fills as many equal
   sequences as the counts allow, so the work is bounded by lengths, not by documents.

The plan then goes back to the documents as rank ranges per length: the r-th tail of a
length knows its sequence and offset without meeting any other document.

Defined cases: null text counts as empty; an empty text is the end id alone; rows are kept
one by one, so repeated rows and repeated or null ids each get their own pieces; an empty
table gives an empty result; other columns are ignored. Texts of any length are encoded
whole, a text longer than a window is cut at multiples of it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm.common import read, stage

WINDOW, END_ID = 4096, 2
_MAX_REPEAT = 8          # depth of a combination: m + n at most this
_CACHE_PARTS = 2_000_000  # pre-tokens one Python worker keeps; beyond it the cache starts anew
_CHUNK = 8_000_000        # bytes of text encoded together
# White space of the tokenizer's own pattern; str.split() also cuts at \x1c-\x1f.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = re.compile("[\x1c-\x1f]")
# Letters, then marks without an apostrophe: two pre-tokens at most, whatever the letters are.
_LETTERS, _MARKS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]", "[!-&(-/:-@\\[-`{-~]"
_PROBE = "abcdefghijklmnopqrstuvwxyz", "the", "!", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN, _ONE = f"^(?P<letters>{_LETTERS}*)(?P<marks>{_MARKS}*)$", f"^({_LETTERS}+|{_MARKS}+)$"


def split(text: str | None) -> list[str]:
    if not text:
        return []
    return [w for w in _SPACE.split(text) if w] if _ODD.search(text) else text.split()


class WordIds:
    """Ids of white-space separated words by a ``tokenizers`` file, each pre-token encoded once.

    For tokenizers that lower-case, drop white space, cut between letters and marks and end
    every pre-token with a piece that carries the word-end suffix. A word of letters and
    marks is put together from the two; any other word is encoded as it stands. Words and
    pre-tokens are cut, told apart and looked up by Arrow; only new pre-tokens become Python strings.
    """

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("word_bpe_49k.json")
        self.tok = Tokenizer.from_file(path)
        suffix = self.tok.model.end_of_word_suffix
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends[[i for w, i in self.tok.get_vocab().items() if w.endswith(suffix)]] = True
        # whether what stands before the model leaves lower-case ASCII pre-tokens as they are
        self.bare = all(self._model_ids(w) == self.tok.encode(w, add_special_tokens=False).ids for w in _PROBE)
        self.clear()

    def _model_ids(self, part: str) -> list[int]:
        return [t.id for t in self.tok.model.tokenize(part)]

    def clear(self):
        self.parts = pa.array([""], pa.string())  # pre-tokens; their rows have start and count in flat
        self.flat, self.start, self.count = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def learn(self, parts: pa.Array) -> np.ndarray:
        """Encode new pre-tokens and say their rows."""
        plain = pc.match_substring_regex(parts, _ONE)
        direct = pc.and_(plain, pc.string_is_ascii(parts)) if self.bare else pa.array(np.zeros(len(parts), bool))
        kinds = direct, pc.and_not(plain, direct), pc.invert(plain)
        alone, joined, odd = (parts.filter(k).to_pylist() for k in kinds)
        found = [self._model_ids(w) for w in alone]
        counts = [np.fromiter(map(len, found), np.int64, len(found))]
        found = [np.fromiter(chain.from_iterable(found), np.uint32)]
        for lo in range(0, len(joined), 2000):
            some = joined[lo:lo + 2000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(some):
                raise ValueError("this tokenizer does not end each pre-token with the word-end suffix")
            found.append(ids)
            counts.append(np.diff(last, prepend=-1))
        if odd:
            each = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(odd, add_special_tokens=False)]
            found += each
            counts.append(np.array([len(x) for x in each], np.int64))
        counts = np.concatenate(counts)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, *found])
        at = np.concatenate([np.flatnonzero(k.to_numpy(zero_copy_only=False)) for k in kinds])
        rows = np.empty(len(parts), np.int64)
        rows[at] = len(self.parts) + np.arange(len(parts))
        self.parts = pa.concat_arrays([self.parts, parts.take(pa.array(at))])
        return rows

    def _pairs(self, words: pa.Array) -> np.ndarray:
        """Rows of the two pre-tokens of each word, the second empty where the word is encoded as it stands."""
        cut = pc.extract_regex(words, _PLAIN)
        plain = pc.is_valid(cut)
        letters = pc.if_else(plain, pc.utf8_lower(pc.struct_field(cut, "letters")), words)
        marks = pc.if_else(plain, pc.struct_field(cut, "marks"), "")
        parts = pa.concat_arrays([letters, marks]).dictionary_encode()
        if len(self.parts) > _CACHE_PARTS:
            self.clear()
        rows = pc.fill_null(pc.index_in(parts.dictionary, value_set=self.parts), -1).to_numpy().astype(np.int64)
        new = rows < 0
        if new.any():
            rows[new] = self.learn(parts.dictionary.filter(pa.array(new)))
        return rows[parts.indices.to_numpy()].reshape(2, len(words)).T

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of each text; words are split and told apart by Arrow, so only distinct ones are looked up."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        column = pc.fill_null(column, "")
        if pc.any(pc.match_substring_regex(column, _ODD.pattern)).as_py():
            lists = pa.array([split(t) for t in column.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.utf8_split_whitespace(column)  # cuts where str.split() does; an empty word has no ids
        coded = lists.flatten().dictionary_encode()
        at = self._pairs(coded.dictionary.cast(pa.string()))[coded.indices.to_numpy()]
        ids = self._gather(at.ravel())
        size = np.concatenate([[0], np.cumsum(self.count[at].sum(1))])
        cut = size[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
        return [ids[lo:hi] for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def _gather(self, at: np.ndarray) -> np.ndarray:
        n = self.count[at]
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.uint32)
        return self.flat[np.arange(total) + np.repeat(self.start[at] - np.cumsum(n) + n, n)]


_ENCODERS: dict[str | None, WordIds] = {}  # one per Python worker, kept from task to task


def _piece_rows(tokenizer_path: str | None, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if tokenizer_path not in _ENCODERS:
                _ENCODERS[tokenizer_path] = WordIds(tokenizer_path)
            doc, texts = b.column(0).to_pylist(), b.column(1)
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
            part = np.cumsum(size) // _CHUNK  # bounded texts at a time, or one longer text
            cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(doc)] if len(doc) else [0]
            for lo, hi in zip(cut, cut[1:]):
                out = ([], [], [], [], [])
                for d, found in zip(doc[lo:hi], _ENCODERS[tokenizer_path].encode(texts.slice(lo, hi - lo))):
                    ids = np.append(found, np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(ids), window):
                        piece = ids[s:s + window]
                        for o, v in zip(out, (d, s, len(piece), zlib.crc32(piece.tobytes()), len(ids))):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


# ---------------------------------------------------------------- plan over the histogram

def combinations(hist: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """(a, m, b, n) with ``m*a + n*b == window``, a > b, m >= 1, n >= 0, m + n <= 8, all present."""
    has = np.flatnonzero(hist)
    out = []
    for a in has[::-1].tolist():
        for m in range(1, min(_MAX_REPEAT, window // a) + 1):
            rest = window - m * a
            if rest == 0:
                out.append((a, m, 0, 0))
                continue
            for n in range(1, _MAX_REPEAT - m + 1):
                b, r = divmod(rest, n)
                if r == 0 and 0 < b < a and hist[b]:
                    out.append((a, m, b, n))
    return out


def nnls(cols: list[tuple[int, int, int, int]], hist: np.ndarray, steps: int = 300) -> np.ndarray:
    """argmin over x >= 0 of ``|A x - hist|`` by accelerated projected gradient; A has two entries a column."""
    c = np.array(cols, np.int64).reshape(-1, 4)
    a, m, b, n = c[:, 0], c[:, 1].astype(float), c[:, 2], c[:, 3].astype(float)
    apply = lambda x: np.bincount(a, m * x, len(hist)) + np.bincount(b, n * x, len(hist))
    back = lambda r: m * r[a] + n * r[b]
    target = hist.astype(float)
    v = np.ones(len(c))
    for _ in range(20):  # largest eigenvalue of A'A, for the step length
        v = back(apply(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(c))
    t = 1.0
    for _ in range(steps):
        nx = np.maximum(0, y - back(apply(y) - target) / (1.05 * top))
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = nx + (t - 1) / nt * (nx - x), nx, nt
    return x


def plan(hist: np.ndarray, window: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, how many per sequence)], sequences) that use every tail exactly once."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    patterns = []
    cols = combinations(left, window)
    if cols:
        x = nnls(cols, left)
        for j in np.argsort(-x, kind="stable").tolist():
            a, m, b, n = cols[j]
            k = min(int(x[j] + 1e-6), int(left[a]) // m, int(left[b]) // n if n else int(x[j] + 1e-6))
            if k > 0:
                left[a] -= k * m
                if n:
                    left[b] -= k * n
                patterns.append(([(a, m)] + ([(b, n)] if n else []), k))
    while left.any():  # longest first; every step uses up at least one length
        room, use = window, []
        while room > 0:
            fit = np.flatnonzero(left[:room + 1])
            for got, q in use:
                fit = fit[fit != got]
            if not len(fit):
                break
            big = int(fit[-1])
            q = min(room // big, int(left[big]))
            use.append((big, q))
            room -= q * big
        k = min(int(left[length]) // q for length, q in use)
        for length, q in use:
            left[length] -= k * q
        patterns.append((use, k))
    return patterns


def _ranges(patterns, window: int):
    """Arrays sorted by (length, first rank): where the ranks of a length go."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for use, k in patterns:
        offset = 0
        for length, q in use:
            first = used.get(length, 0)
            rows.append((length, first, q, base, offset))
            used[length] = first + k * q
            offset += q * length
        base += k
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5), base


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    types = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = stage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_piece_rows(tokenizer_path, window, end_id), types)
        .withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}), "pieces")
    counts = stage(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece_counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("length", "part").orderBy("nth")) - 1).join(
        counts.select("length", "part", before.alias("before")), ["length", "part"]).withColumn("rank", F.col("before") + F.col("r"))
    # At most window counts come back; the plan's size depends on lengths, not on documents.
    hist = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        hist[r["length"]] = r["n"]
    whole, hist[window] = int(hist[window]), 0
    patterns = plan(hist, window)
    table, base = _ranges(patterns + ([([(window, 1)], whole)] if whole else []), window)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = np.int64(1 << 44)
        keys = table[:, 0] * big + table[:, 1]
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            row = table[np.searchsorted(keys, length * big + rank, side="right") - 1]
            i = rank - row[:, 1]
            seq, offset = row[:, 3] + i // row[:, 2], row[:, 4] + i % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(5)), pa.array(seq), pa.array(offset)],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long")).mapInArrow(
        assign, f"{types}, sequence_id long, offset long")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


QUERIES = {"op10_packing": op10_packing}

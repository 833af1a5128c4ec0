"""Suffix-array dedup: every byte covered by a 200-byte string that starts anywhere else goes.

Finding the places to sort (no suffix array of a whole corpus fits a task):

* Every 200-byte window picks its least 32-byte gram (leftmost of equals) as *anchor*. Equal
  windows pick equal anchors at equal offsets, so windows only meet others of their anchor.
  About 1.4 % of the positions are anchors.
* An anchor's *context* is the union of the windows that picked it. A context that stands
  twice is repeated as a whole. Anchors with one context that stands once are done.
* The windows of the remaining contexts are dealt into eight ranges of offsets. All windows of
  a range share a *core* of at least 179 bytes, so only contexts with equal cores are compared.

Contexts with the same core form a string set in which the core is one letter and up to 21
bytes stand on either side. Its suffix array is built by linear grouping: suffixes are
grouped by Lyndon prefix, groups processed in descending order along previous-smaller
pointers, and the order inside the groups is emitted in one ascending sweep; nothing is
renamed or sorted recursively. Neighbours in the array that agree over a window repeat it.
Sets of more than ``_SET`` texts go by window digests instead (a count per digest), so a set
of any size is exact and no task has to hold it.

Defined cases: null text counts as empty (null stays null in ``cut``); texts shorter than
200 bytes lose nothing; rows that agree in doc_id and text stand twice and therefore lose all
their windows; an empty table gives an empty result; other columns pass through ``cut``.
Texts of any length are read whole, in overlapping pieces.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import mix64, read, release, stage

LENGTH = 200
_GRAM = 32            # bytes of an anchor
_RANGE = 22           # window offsets that share a core
_SET = 20_000         # texts with one core that go into a suffix array
_PIECE = 1 << 22      # bytes worked on at once
_BROADCAST_ROWS = 400_000
_BROADCAST_KEYS = 1_000_000
_ODD = 0x9E3779B97F4A7C15
_LETTER = mix64(np.arange(256, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(int(out[-1]) * base % (1 << 64))])
    return out[:n]


_UP, _DOWN = _powers(_ODD, 1 << 16), _powers(pow(_ODD, -1, 1 << 64), 1 << 16)


def _tables(n: int):
    global _UP, _DOWN
    if len(_UP) < n:
        _UP, _DOWN = _powers(_ODD, 2 * n), _powers(pow(_ODD, -1, 1 << 64), 2 * n)
    return _UP, _DOWN


def anchors(b: np.ndarray, length: int = LENGTH):
    """(gram digest, position, first window, last window) of every anchor of one piece."""
    k = len(b) - length + 1
    if k < 1:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    with np.errstate(over="ignore"):
        h, m, base = _LETTER[b], 1, _ODD
        while m < _GRAM:  # digests of 2, 4, ... bytes
            longer = h[:-m] * np.uint64(base)
            longer += h[m:]
            h, base, m = longer, base * base % (1 << 64), 2 * m
    w, m = length - _GRAM + 1, 1
    h = mix64(h)
    v = h & ~np.uint64(0xFFFFFF)
    v |= np.arange(len(h), dtype=np.uint64)  # the leftmost of equals is the least
    while 2 * m <= w:  # least of 2, 4, ... grams
        v, m = np.minimum(v[:-m], v[m:]), 2 * m
    v = np.minimum(v[:k], v[w - m:])
    at = (v & np.uint64(0xFFFFFF)).astype(np.int64)
    lo = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    return h[at[lo]], at[lo], lo, np.append(lo[1:], k) - 1


def digests(b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit digest of each ``b[lo:hi]``."""
    up, down = _tables(len(b) + 1)
    with np.errstate(over="ignore"):
        q = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[b] * up[:len(b)], dtype=np.uint64)))
        return mix64((q[hi] - q[lo]) * down[lo] + mix64((hi - lo).astype(np.uint64)))


def pieces(text: bytes, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    b = np.frombuffer(text, np.uint8)
    for lo in range(0, max(len(b) - length + 1, 0), _PIECE):
        yield lo, b[lo:lo + _PIECE + length - 1]


def _i64(x) -> pa.Array:
    return pa.array(np.asarray(x).view(np.int64) if np.asarray(x).dtype == np.uint64 else np.asarray(x, np.int64))


def _anchor_rows(length: int):
    names = ["r1", "r2", "akey", "ctx", "pos", "before", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r1, r2, texts = (batch.column(i) for i in range(3))
            out: list[list[np.ndarray]] = [[] for _ in names[2:]]
            row, count = [], []
            for i, t in enumerate(texts):
                for base, p in pieces(t.as_py() or b"", length):
                    key, pos, lo, hi = anchors(p, length)
                    with np.errstate(over="ignore"):
                        ctx = mix64(digests(p, lo, hi + length) ^ (pos - lo).astype(np.uint64))
                    row.append(i)
                    count.append(len(key))
                    for o, v in zip(out, (key.view(np.int64), ctx.view(np.int64), base + pos, pos - lo, hi - lo + 1)):
                        o.append(v)
            row = np.repeat(np.array(row, np.int64), np.array(count, np.int64))
            cols = [r.to_numpy(zero_copy_only=False)[row] for r in (r1, r2)] + [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
            for lo in range(0, max(len(cols[0]), 1), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo:lo + 20_000]).cast(pa.int64() if i < 5 else pa.int32()) for i, c in enumerate(cols)], names)
    return run


def _range_rows(length: int):
    """Contexts of one document row -> their windows by range: core, sides, digest of both."""
    names = ["r1", "r2", "akey", "core", "clip", "first", "n", "left", "right"]
    rng = range(0, length - _GRAM + 1, _RANGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for row in batch.to_pylist():
                text = row["text"] or b""
                for akey, pos, before, n in zip(row["akey"], row["pos"], row["before"], row["n"]):
                    for number, a0 in enumerate(rng):
                        a1 = min(a0 + _RANGE - 1, length - _GRAM)
                        first, last = max(pos - before, pos - a1), min(pos - before + n - 1, pos - a0)
                        if first > last:
                            continue
                        c0, c1 = pos - a0, pos + length - a1
                        left, right = text[first:c0], text[c1:last + length]
                        core = xxhash.xxh64_intdigest(text[c0:c1], number) - (1 << 63)
                        clip = xxhash.xxh64_intdigest(left + b"|" + right, len(left)) - (1 << 63)
                        for o, v in zip(out, (row["r1"], row["r2"], akey, core, clip, first, last - first + 1, left, right)):
                            o.append(v)
                if len(out[0]) > 20_000:
                    yield _batch(out, names)
                    out = [[] for _ in names]
            yield _batch(out, names)
    return run


def _batch(out: list[list], names: list[str]) -> pa.RecordBatch:
    kind = {"left": pa.binary(), "right": pa.binary(), "n": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(o, kind.get(k, pa.int64())) for o, k in zip(out, names)], names)


# ---------------------------------------------------------------- suffix array

def suffix_array(text: Sequence[int] | np.ndarray) -> list[int]:
    """Suffix array of non-negative integers by Lyndon grouping.

    First sweep, groups in descending order: ``prev[s]`` becomes the nearest position to the
    left whose group is smaller; the suffixes found that way have the group's Lyndon prefix
    behind their own and split off above their old group, the more often the higher.
    Second sweep, ascending: a suffix in place puts those that continue into it at the
    front of their groups.
    """
    n = len(text)
    if not n:
        return []
    letters = np.asarray(text, np.int64)
    order = np.argsort(letters, kind="stable")
    sa = order.tolist()
    place = [0] * n          # where a suffix stands in sa
    for i, s in enumerate(sa):
        place[s] = i
    sorted_letters = letters[order]
    starts = np.concatenate(([0], np.flatnonzero(sorted_letters[1:] != sorted_letters[:-1]) + 1))
    sizes = np.diff(starts, append=n)
    size = [0] * (n + 1)
    head = [0] * n           # first place of the suffix's group
    for s, m in zip(starts.tolist(), sizes.tolist()):
        size[s] = m
    for s, h in zip(sa, np.repeat(starts, sizes).tolist()):
        head[s] = h
    prev = [-1] * n
    end = n
    while end > 0:
        start = head[sa[end - 1]]
        if end - start == 1:  # one suffix moves one at most: to the end of its group, on its own
            p = sa[start] - 1
            while p >= 0 and head[p] >= start:
                p = prev[p]
            prev[sa[start]] = p
            if p >= 0 and size[head[p]] > 1:
                g = head[p]
                size[g] -= 1
                to, at = g + size[g], place[p]
                other = sa[to]
                sa[to], sa[at] = p, other
                place[p], place[other] = to, at
                head[p] = to
                size[to] = 1
            end = start
            continue
        times: dict[int, int] = {}
        for s in sorted(sa[start:end]):
            p = s - 1
            while p >= 0 and head[p] >= start:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            counts = set(times.values())
            for c in sorted(counts, reverse=True):
                some = list(times) if len(counts) == 1 else [p for p, k in times.items() if k == c]
                for p in some:
                    g = head[p]
                    size[g] -= 1
                    to, at = g + size[g], place[p]
                    other = sa[to]
                    sa[to], sa[at] = p, other
                    place[p], place[other] = to, at
                new = {head[p]: head[p] + size[head[p]] for p in some}
                for p in some:
                    h = new[head[p]]
                    head[p] = h
                    size[h] += 1
        end = start
    front = list(range(n))   # next free place of the group that begins here
    done = [False] * n
    out = [-1] * n
    for r in range(-1, n):
        i = out[r] if r >= 0 else n
        j = i - 1
        while j >= 0 and not done[j]:
            h = head[j]
            out[front[h]] = j
            front[h] += 1
            done[j] = True
            j = prev[j]
    return out


def repeated_windows(sets: list[list[tuple[bytes, bytes, int]]], length: int = LENGTH) -> list[list[list[int]]]:
    """Per set of (left, right, core bytes) with one core: the windows of each text that another text has too.

    A window is named by its start in ``left``; all of them hold the core.
    """
    rows = [m for members in sets for m in members]
    left, right, core = np.array([(len(a), len(b), c) for a, b, c in rows], np.int64).reshape(-1, 3).T
    begin = np.cumsum(left + right + 2) - (left + right + 2)
    text = np.frombuffer(b"".join(x for a, b, _ in rows for x in (a, b"\0", b, b"\0")), np.uint8) + np.int64(1)
    text[begin + left] = 257 + np.repeat(np.arange(len(sets)), [len(members) for members in sets])
    text[begin + left + right + 1] = 0
    rest = length - core  # letters of a window beside the core
    low, high = np.maximum(left - rest, 0), np.minimum(left, left + right - rest)
    count = np.maximum(high - low + 1, 0)
    owner = np.full(len(text), -1)
    owner[np.arange(count.sum()) + np.repeat(begin + low - np.cumsum(count) + count, count)] = np.repeat(np.arange(len(rows)), count)
    order = np.array(suffix_array(text), np.int64)
    order = order[owner[order] >= 0]  # windows
    x, y = order[:-1], order[1:]
    alike = rest[owner[x]] == rest[owner[y]]
    x, y = x[alike], y[alike]
    for i in range(int(rest.max(initial=-1)) + 1):
        alike = (i > rest[owner[x]]) | (text[np.minimum(x + i, len(text) - 1)] == text[np.minimum(y + i, len(text) - 1)])
        x, y = x[alike], y[alike]
    found: list[list[int]] = [[] for _ in rows]
    hit = np.unique(np.concatenate([x, y]))
    for k, start in zip(owner[hit].tolist(), (hit - begin[owner[hit]]).tolist()):
        found[k].append(start)
    each = iter(found)
    return [[next(each) for _ in members] for members in sets]


def _set_spans(length: int):
    """Rows of one core together (sorted) -> spans of the windows that repeat."""
    names = ["r1", "r2", "lo", "hi"]

    def solve(groups: list[list[dict]]) -> pa.RecordBatch:
        sets = [[(r["left"], r["right"], r["n"] - 1 + length - len(r["left"]) - len(r["right"])) for r in g] for g in groups]
        out: list[list[int]] = [[] for _ in names]
        for g, found in zip(groups, repeated_windows(sets, length)):
            for r, starts in zip(g, found):
                if r["copies"] == 1:
                    for lo, hi in _runs(starts):
                        for o, v in zip(out, (r["r1"], r["r2"], r["first"] + lo, r["first"] + hi + length)):
                            o.append(v)
        return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[dict]] = []
        key, letters = None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if (r["akey"], r["core"]) != key:
                    if letters > 20_000:
                        yield solve(groups)
                        groups, letters = [], 0
                    key = (r["akey"], r["core"])
                    groups.append([])
                groups[-1].append(r)
                letters += len(r["left"]) + len(r["right"]) + 2
        if groups:
            yield solve(groups)
    return run


def _runs(starts: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and out[-1][1] == s - 1:
            out[-1] = (out[-1][0], s)
        else:
            out.append((s, s))
    return out


def _window_digests():
    """Rows of large sets -> one digest per window."""
    names = ["akey", "core", "window", "r1", "r2", "first", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[] for _ in names]
            for r in batch.to_pylist():
                for j in range(r["n"]):
                    seen = r["left"][j:] + b"|" + r["right"][:len(r["right"]) - (r["n"] - 1 - j)]
                    digest = xxhash.xxh64_intdigest(seen, len(r["left"]) - j) - (1 << 63)
                    for o, v in zip(out, (r["akey"], r["core"], digest, r["r1"], r["r2"], r["first"] + j, r["copies"])):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names)
    return run


# ---------------------------------------------------------------- on DataFrames

def _counted(rows: DataFrame, group: str | list[str], item: str) -> DataFrame:
    """``rows`` of groups with two rows or more, with copies (rows of this item) and kinds (items of the group)."""
    group = [group] if isinstance(group, str) else group
    items = rows.groupBy(*group, item).agg(F.count("*").alias("copies"))
    groups = items.groupBy(*group).agg(F.count("*").alias("kinds"), F.sum("copies").alias("all")).where("all > 1").drop("all")
    return rows.join(items.join(groups, group), [*group, item])


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast a staged table when its rows, and the spans in them, are within the bound."""
    found = df.agg(F.count("*").alias("n"), F.sum("weight").alias("w")).first()
    return F.broadcast(df.drop("weight")) if found["n"] <= _BROADCAST_ROWS and (found["w"] or 0) <= 5 * _BROADCAST_ROWS else df.drop("weight")


def _keys(doc_id, text) -> dict:
    return {"r1": F.xxhash64(doc_id, text), "r2": F.xxhash64(F.lit(7), doc_id, text)}


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(r1, r2, lo, hi, weight): digests of a document row, its byte ranges that go, joined where they touch, and their number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns(
        _keys(F.col("doc_id"), F.col("text"))).select("r1", "r2", F.col("text").cast("binary").alias("text")).where(F.octet_length("text") >= length)
    found = stage(rows.mapInArrow(_anchor_rows(length), "r1 long, r2 long, akey long, ctx long, pos long, before int, n int"), "anchors")
    twice = stage(found.groupBy("akey").count().where("count > 1").select("akey"), "repeated_grams")
    few = twice.limit(_BROADCAST_KEYS + 1).count() <= _BROADCAST_KEYS  # rows of 8 bytes
    again = stage(found.join(F.broadcast(twice) if few else twice, "akey"), "anchors_again")
    seen = stage(_counted(again, "akey", "ctx"), "repeated_anchors")
    first = F.col("pos") - F.col("before")
    whole = seen.where("copies > 1").select("r1", "r2", first.alias("lo"), (first + F.col("n") + length - 1).alias("hi"))

    open_ = seen.where("kinds > 1").dropDuplicates(["akey", "ctx"])
    wanted = open_.groupBy("r1", "r2").agg(*(F.collect_list(c).alias(c) for c in ("akey", "pos", "before", "n")), F.count("*").alias("weight"))
    release(found, twice, again)
    contexts = stage(wanted, "open_contexts")
    ranges = stage(rows.join(_sized(contexts), ["r1", "r2"]).mapInArrow(
        _range_rows(length), "r1 long, r2 long, akey long, core long, clip long, first long, n int, left binary, right binary"), "ranges")
    known = stage(_counted(ranges, ["akey", "core"], "clip"), "repeated_cores")
    release(ranges, contexts)
    last = F.col("first") + F.col("n") - 1
    parts = known.where("copies > 1").select("r1", "r2", F.col("first").alias("lo"), (last + length).alias("hi"))
    sets = known.where("kinds > 1").dropDuplicates(["akey", "core", "clip"])
    types = "r1 long, r2 long, lo long, hi long"
    sorted_ = sets.where(F.col("kinds") <= _SET).repartition("akey", "core").sortWithinPartitions("akey", "core", "clip")
    small = sorted_.select("r1", "r2", "akey", "core", "first", "n", "left", "right", "copies").mapInArrow(_set_spans(length), types)
    windows = sets.where(F.col("kinds") > _SET).mapInArrow(
        _window_digests(), "akey long, core long, window long, r1 long, r2 long, first long, copies long")
    at = ["akey", "core", "window"]
    large = windows.join(windows.groupBy(*at).count().where("count > 1").drop("count"), at).where("copies = 1").select(
        "r1", "r2", F.col("first").alias("lo"), (F.col("first") + length).alias("hi"))
    every = whole.union(parts).union(small).union(large).groupBy("r1", "r2").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("s"))  # of one document
    merged = stage(every.select("r1", "r2", F.expr(_MERGED).alias("s")).select(
        "r1", "r2", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), F.size("s").alias("weight")), "spans")
    release(seen, known)
    return merged


#: Sorted spans joined where they touch or overlap.
_MERGED = """aggregate(s, cast(array() as array<struct<lo: bigint, hi: bigint>>), (a, x) ->
  CASE WHEN size(a) > 0 AND a[size(a) - 1].hi >= x.lo
    THEN concat(slice(a, 1, size(a) - 1), array(named_struct('lo', a[size(a) - 1].lo, 'hi', greatest(a[size(a) - 1].hi, x.hi))))
    ELSE concat(a, array(x)) END)"""


def _cut(texts: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
    """Per text: what stays (bytes and text), bytes removed, maximal removed runs."""
    out = []
    for text, a, b in zip(texts, lo, hi):
        text = text or b""
        kept, removed, runs, end = [], 0, 0, 0
        if a is not None and len(a):
            a, b = np.asarray(a), np.asarray(b)
            order = np.argsort(a, kind="stable")
            a, reach = a[order], np.maximum.accumulate(b[order])
            new = np.concatenate(([True], a[1:] > reach[:-1]))
            for x, y in zip(a[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)].tolist()):
                kept.append(text[end:x])
                removed, runs, end = removed + y - x, runs + 1, y
        kept.append(text[end:])
        whole = b"".join(kept)
        out.append((whole.decode("utf-8", "ignore"), removed, runs, hashlib.sha256(whole).hexdigest()))
    return pd.DataFrame(out, columns=["text", "n_removed", "n_spans", "kept_sha256"])


def cut(docs: DataFrame, length: int = LENGTH, counts: bool = False) -> DataFrame:
    """``docs`` without the repeated bytes of ``text`` (letters cut in half go too).

    With ``counts`` also n_bytes, n_removed, n_spans and kept_sha256 (of the remaining bytes).
    """
    found = spans(docs, length)
    tag = uuid.uuid4().hex  # helper names that no column of docs can have
    r1, r2, lo, hi, c = (f"{x}_{tag}" for x in ("r1", "r2", "lo", "hi", "cut"))
    keys = _keys(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    both = docs.withColumns({r1: keys["r1"], r2: keys["r2"]}).join(_sized(found).toDF(r1, r2, lo, hi), [r1, r2], "left")
    work = F.pandas_udf(_cut, "text string, n_removed long, n_spans long, kept_sha256 string")
    both = both.withColumn(c, work(F.col("text").cast("string").cast("binary"), F.col(lo), F.col(hi)))
    text = F.when(F.col("text").isNotNull(), F.col(f"{c}.text"))
    extra = [F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), *(F.col(f"{c}.{x}") for x in ("n_removed", "n_spans", "kept_sha256"))]
    return both.select(*(text.alias("text") if x == "text" else F.col(f"`{x}`") for x in docs.columns), *(extra if counts else []))


def op8_suffix(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return cut(docs, counts=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op8_suffix": op8_suffix}

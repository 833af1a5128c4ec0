"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints (64 bits) come from word shingles. Two fingerprints that differ in at most
``max_bits`` bits differ in at most that many of their 8 bytes, so they share at least
``8 - max_bits`` positional bytes. The index posts every distinct fingerprint under each
combination of three of its first seven positional bytes: a pair with four shared positions
has three of them among any seven, so it meets in some posting. Within a posting, pairs are
tallied (equal positional bytes), kept from the guaranteed minimum on, and verified by the
Hamming distance. Equal fingerprints are one posting entry, copies never form pairs.

A posting answers with a spanning forest of its links, not with the links. A posting longer
than ``_BLOCK`` is dealt out as pairs of blocks, each pair a task of bounded size, so the
answer stays exact for postings of any length. ``components`` then joins the forests.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other;
rows are never merged (repeated rows give repeated results); a null doc_id stays in its
component, whose id is the smallest id that is not null (null if there is none); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import components, read, release, stage

SHINGLE, MAX_BITS = 4, 4
_BLOCK = 2048     # posting entries compared in one step
_SEED = 42
_BROADCAST_ROWS = 500_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased (A-Z) words split at ASCII white space, as unsigned 64 bits."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), _SEED)
    flat = b" ".join(words)
    n = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(n + 1) - 1
    first, last = (end - n)[:1 - shingle].tolist(), end[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), len(first)
    for lo in range(0, total, 8192):  # bounded memory for very long texts
        h = np.fromiter((digest(flat[a:b], _SEED) for a, b in zip(first[lo:lo + 8192], last[lo:lo + 8192])), np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, r1, r2, fp): row digests, and the fingerprint as a signed long."""
    names = ["doc_id", "r1", "r2", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3)
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(fp)], names)

    r1, r2 = _digests(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), r1.alias("r1"), r2.alias("r2"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, r1 long, r2 long, fp long")


def _digests(docs: DataFrame) -> tuple[Column, Column]:
    every = [F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(*every), F.xxhash64(F.lit(7), *every)


def _linked(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Count filter, then verification, on the XOR of two fingerprints."""
    shared = (x[..., None].view(np.uint8) == 0).sum(-1)
    return (shared >= 8 - max_bits) & (np.bitwise_count(x) <= max_bits)


def forest(a: np.ndarray, b: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect exactly what the links between ``a`` and ``b`` (uint64) connect."""
    hit = np.zeros((len(a), len(b)), bool)
    for lo in range(0, len(a), 256):
        hit[lo:lo + 256] = _linked(a[lo:lo + 256, None] ^ b[None, :], max_bits)
    i, j = np.nonzero(hit)
    if not len(i):
        return []
    both, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, w = at[:len(a)][i], at[len(a):][j]
    label = np.arange(len(both))
    while True:  # least label over the links, with pointer jumps
        low = np.minimum(label[u], label[w])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, w, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(both)))
    return [(both[moved], both[label[moved]])]


def _posting_edges(max_bits: int):
    """Over rows (key, fp) sorted by key: forest edges of every posting."""
    def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        cut = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        size = np.diff(cut)
        small = np.repeat(size <= 32, size)
        k, f = key[small], fp[small]
        for d in range(1, 32):  # short postings: all of them at once, by distance in the order
            same = np.flatnonzero(k[d:] == k[:-d])
            if not len(same):
                break
            hit = same[_linked(f[same] ^ f[same + d], max_bits)]
            out.append((f[hit], f[hit + d]))
        for lo, n in zip(cut[:-1][size > 32], size[size > 32]):
            out += forest(fp[lo:lo + n], fp[lo:lo + n], max_bits)
        a, b = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.uint64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            key = np.concatenate([key, b.column(0).to_numpy()])
            fp = np.concatenate([fp, b.column(1).to_numpy().view(np.uint64)])
            if len(key):  # the last posting may go on in the next batch
                whole = int(np.searchsorted(key, key[-1]))
                if whole:
                    yield edges(key[:whole], fp[:whole])
                    key, fp = key[whole:], fp[whole:]
        if len(key):
            yield edges(key, fp)
    return run


def _block_edges(max_bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, blk = pdf["fp"].to_numpy().view(np.uint64), pdf["blk"].to_numpy()
        a, b = fp[blk == pdf["i"].iat[0]], fp[blk == pdf["j"].iat[0]]
        out = forest(a, b, max_bits)
        a, b = out[0] if out else (fp[:0], fp[:0])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
    return run


def _postings(distinct: DataFrame) -> DataFrame:
    """(key, fp, n): every fingerprint under its keys, where another one has the key too, with the posting's size."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = [F.lit(t << 24) + byte(a) * 65536 + byte(b) * 256 + byte(c) for t, (a, b, c) in enumerate(combinations(range(7), 3))]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Spark sizes both sides like ``distinct``, without the 35 rows of each, and would broadcast one
    return rows.hint("merge").join(sizes, "key")


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = _BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all links."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the index guarantees a common posting for at most 4 differing bits")
    posted = stage(_postings(distinct), "postings")
    short = posted.where(F.col("n") <= block).select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(
        _posting_edges(max_bits), "a long, b long")
    long = posted.where(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / F.lit(block // 2)).cast("int"))
    long = long.withColumn("blk", F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    long = long.select("key", "fp", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j")).groupBy(
        "key", "i", "j").applyInPandas(_block_edges(max_bits), "a long, b long")
    found = stage(short.union(long), "fp_links")
    release(posted)
    return found


def _grouped(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """doc_id, r1, r2, fp, root (one fingerprint of the component) per row of ``docs``."""
    fp = stage(fingerprints(docs, shingle), "fingerprints")
    distinct = stage(fp.select("fp").distinct(), "distinct_fp")
    comp = components(links(distinct, max_bits)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = distinct.join(comp, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return fp.join(rooted, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    rows = _grouped(docs.select("doc_id", "text"), shingle, max_bits)
    low = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(low, "root").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The row of each component with the smallest doc_id (nulls last, then by row digest), all columns kept."""
    rows = stage(_grouped(docs, shingle, max_bits), "grouped")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "r1", "r2")).alias("m")
    winners = stage(rows.groupBy("root").agg(best).select("m.r1", "m.r2"), "winners")
    few = winners.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS  # rows of 16 bytes
    tag = uuid.uuid4().hex  # helper names that no column of docs can have
    keys = [f"r1_{tag}", f"r2_{tag}"]
    marked = docs.withColumns(dict(zip(keys, _digests(docs))))
    kept = marked.join(F.broadcast(winners.toDF(*keys)) if few else winners.toDF(*keys), keys, "left_semi")
    repeated = rows.join(winners, ["r1", "r2"]).groupBy("r1", "r2").count().where("count > 1")
    if not repeated.isEmpty():  # rows equal in every column
        kept = kept.dropDuplicates(keys)
    return kept.drop(*keys)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op4_simhash": op4_simhash}

"""Near-duplicate vectors through randomised-rotation binary codes with correction factors.

A unit vector o is padded and rotated by a seeded random rotation R; its code is the sign of
every rotated coordinate, c = sign(R o) / sqrt(D). Stored with the code is its correction
factor f = <c, R o>. For another unit vector q, <c, R q> / f is an unbiased estimate of
<o, q>, and its error exceeds ``EPSILON`` * sqrt(1 - f^2) / f / sqrt(D - 1) with a probability
of about exp(-EPSILON^2 / 2). A pair whose estimate plus that bound stays below the threshold
is dropped; every other pair is computed again exactly, in double precision, and linked only
if its cosine is at or above the threshold.

Which pairs are looked at: the code is cut into ``TABLES`` keys of 16 bits, and two vectors of
a label are compared if they agree in some key. A pair of cosine 0.93 agrees in a bit with
probability 0.880, so it meets with 1 - (1 - 0.880^16)^48 = 0.9987, a closer pair more surely;
unlike vectors meet in 48 of 65536 cases. A pair that agrees in several keys belongs to the
first of them and is counted there only. Equal vectors of a label are one entry with the
number of its copies. A key with more than ``_BLOCK`` entries is dealt out as pairs of blocks,
each a task of bounded size. A block answers with link counts per entry and with a spanning
forest, not with its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
those without a label, link with nothing: no links, a component of their own. Vectors of
different lengths have no cosine and do not link. Repeated rows are vectors like any other.
A null vec_id links as usual; a component's id is its smallest id that is not null (null if
there is none), and ``kept`` compares ids with null equal to null. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import components, read, release, stage

THRESHOLD = 0.93
TABLES = 48       # keys of 16 bits; the code has at least 16 * TABLES bits
EPSILON = 4.0     # width of the confidence bound
_BLOCK = 2048     # entries of a key compared in one step
_SEED = 23
_ENTRY = "label string, dim int, rid long, copies long, code binary, factor double, unit binary"
_FOUND = "a long, b long, n long"


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """The first ``dim`` columns of a random rotation of D = max(16 * TABLES, dim) dimensions (a multiple of 64)."""
    size = max(16 * TABLES, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng((_SEED, dim)).normal(size=(size, dim)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (packed bits) and correction factors of unit vectors."""
    rotated = x @ rotation(x.shape[1])
    return np.packbits(rotated > 0, axis=1), np.abs(rotated).sum(1) / np.sqrt(rotated.shape[1])


def estimates(code: np.ndarray, factor: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (coded vector x query) and the bound on their error per coded vector."""
    rotated = (query @ rotation(query.shape[1])).astype(np.float32)
    signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
    return signs @ rotated.T / (factor * np.sqrt(signs.shape[1]))[:, None], _bound(factor, signs.shape[1])


def _bound(factor: np.ndarray, size: int) -> np.ndarray:
    return EPSILON * np.sqrt(np.maximum(0, 1 - factor ** 2)) / factor / np.sqrt(size - 1) + 1e-5  # single precision


class Entries:
    """Entries of one label and length, as arrays."""

    def __init__(self, rid, copies, code, factor, vectors):
        self.rid, self.copies, self.code, self.factor, self.unit = rid, copies, code, factor, vectors
        self.keys = code.view(np.uint16)[:, :TABLES]

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Entries:
        whole = lambda c, kind: np.frombuffer(b"".join(rows[c]), kind).reshape(len(rows), -1)
        return cls(rows["rid"].to_numpy(), rows["copies"].to_numpy(), whole("code", np.uint8), rows["factor"].to_numpy(), whole("unit", np.float64))

    def take(self, at) -> Entries:
        return Entries(self.rid[at], self.copies[at], self.code[at], self.factor[at], self.unit[at])


def _mine(a: Entries, i: np.ndarray, b: Entries, j: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether ``table`` is the first key in which the pairs agree."""
    return (a.keys[i] == b.keys[j]).argmax(1) == table


def _exact(a: Entries, i: np.ndarray, b: Entries, j: np.ndarray, threshold: float) -> np.ndarray:
    return np.einsum("ij,ij->i", a.unit[i], b.unit[j]) >= threshold


def linked_pairs(e: Entries, i: np.ndarray, j: np.ndarray, table: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) met in ``table``: those that belong to it and are linked."""
    out = []
    for lo in range(0, len(i), 4096):
        p, q = i[lo:lo + 4096], j[lo:lo + 4096]
        own = _mine(e, p, e, q, table[lo:lo + 4096])
        p, q = p[own], q[own]
        signs = np.unpackbits(e.code[p], axis=1).astype(np.float32) * 2 - 1
        rotated = (e.unit[q] @ rotation(e.unit.shape[1])).astype(np.float32)
        estimate = np.einsum("ij,ij->i", signs, rotated) / (e.factor[p] * np.sqrt(signs.shape[1]))
        open_ = estimate + _bound(e.factor[p], signs.shape[1]) >= threshold
        p, q = p[open_], q[open_]
        hit = _exact(e, p, e, q, threshold)
        out.append((p[hit], q[hit]))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


def linked_blocks(a: Entries, b: Entries, table: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (index in a, index in b) of two blocks of a key; ``same``: of one block with itself."""
    out = []
    for lo in range(0, len(a.rid), 256):
        part = a.take(slice(lo, lo + 256))
        own = np.ones((len(part.rid), len(b.rid)), bool)
        for t in range(table):
            own &= part.keys[:, t, None] != b.keys[None, :, t]
        if same:
            own &= np.arange(lo, lo + len(part.rid))[:, None] < np.arange(len(b.rid))[None, :]
        if not own.any():
            continue
        estimate, bound = estimates(part.code, part.factor, b.unit)
        i, j = np.nonzero(own & (estimate + bound[:, None] >= threshold))
        for at in range(0, len(i), 65536):
            p, q = i[at:at + 65536], j[at:at + 65536]
            hit = _exact(part, p, b, q, threshold)
            out.append((p[hit] + lo, q[hit]))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


def _answer(rid: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Link counts (a, -1, n) and forest edges (a, b, 0) of linked pairs of entries."""
    n = np.zeros(len(rid), np.int64)
    np.add.at(n, i, copies[j])
    np.add.at(n, j, copies[i])
    label = np.arange(len(rid))
    while True:  # least label over the links, with pointer jumps
        low, new = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    met, moved = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(rid)))
    return (np.concatenate([rid[met], rid[moved]]), np.concatenate([np.full(len(met), -1), rid[label[moved]]]),
            np.concatenate([n[met], np.zeros(len(moved), np.int64)]))


def _short(threshold: float):
    """Over rows sorted by (label, dim, slot): the answers of all their keys."""
    def found(rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        for _, part in rows.groupby("dim", sort=False):
            e, slot = Entries.of(part), part["slot"].to_numpy()
            new = np.r_[True, (slot[1:] != slot[:-1]) | (part["label"].to_numpy()[1:] != part["label"].to_numpy()[:-1])]
            posting = np.cumsum(new)
            size = np.bincount(posting)[posting]
            few = np.flatnonzero(size <= 32)
            for d in range(1, 32):  # short keys: all of them at once, by distance in the order
                near = few[:-d][posting[few[d:]] == posting[few[:-d]]]
                if not len(near):
                    break
                far = few[np.searchsorted(few, near) + d]
                i, j = linked_pairs(e, near, far, slot[near] >> 16, threshold)
                yield _batch(*_answer(e.rid, e.copies, i, j))
            for p in np.unique(posting[size > 32]):
                one = e.take(posting == p)
                i, j = linked_blocks(one, one, int(slot[posting == p][0]) >> 16, threshold, True)
                yield _batch(*_answer(one.rid, one.copies, i, j))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = b.to_pandas()
            held = rows if held is None else pd.concat([held, rows], ignore_index=True)
            if len(held) < 2:
                continue
            last = held.iloc[-1]  # the last key may go on in the next batch
            open_ = (held["slot"] == last["slot"]) & (held["dim"] == last["dim"]) & (held["label"] == last["label"])
            yield from found(held[~open_])
            held = held[open_]
        if held is not None:
            yield from found(held)
    return run


def _batch(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])


def _long(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j, blk = rows["i"].iat[0], rows["j"].iat[0], rows["blk"].to_numpy()
        if i != j and (blk == blk[0]).all():  # the hash has left one of the two blocks empty
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in "abn"})
        a = Entries.of(rows[blk == i])
        table = int(rows["slot"].iat[0]) >> 16
        if i == j:
            p, q = linked_blocks(a, a, table, threshold, True)
            found = _answer(a.rid, a.copies, p, q)
        else:
            b = Entries.of(rows[blk == j])
            p, q = linked_blocks(a, b, table, threshold, False)
            found = _answer(np.r_[a.rid, b.rid], np.r_[a.copies, b.copies], p, q + len(a.rid))
        return pd.DataFrame(dict(zip("abn", found)))
    return run


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["label", "dim", "rid", "copies", "code", "factor", "unit", "slots"]
    for b in batches:
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = b.filter(pa.array(dims == dim))
            for lo in range(0, part.num_rows, 4096):
                rows = part.slice(lo, 4096)
                x = unit(rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                code, factor = encode(x)
                slots = code.view(np.uint16)[:, :TABLES].astype(np.int32) + (np.arange(TABLES, dtype=np.int32) << 16)
                cuts = pa.array(np.arange(0, slots.size + 1, TABLES, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("label"), rows.column("dim"), rows.column("rid"), rows.column("copies"), pa.array([c.tobytes() for c in code], pa.binary()),
                     pa.array(factor), pa.array([u.tobytes() for u in x], pa.binary()), pa.ListArray.from_arrays(cuts, pa.array(slots.ravel()))], names)


def links(entries: DataFrame, threshold: float = THRESHOLD, block: int = _BLOCK) -> DataFrame:
    """(a, b, n) over distinct vectors (label, dim, rid, copies, v): counts have b = -1, forest edges n = 0."""
    coded = stage(entries.select("label", "dim", "rid", "copies", "v").mapInArrow(_codes, f"{_ENTRY}, slots array<int>"), "codes")
    at = ["label", "dim", "slot"]
    posted = coded.select("label", "dim", "rid", F.explode("slots").alias("slot"))
    shared = posted.groupBy(*at).agg(F.count("*").alias("n")).where("n > 1")
    met = stage(posted.join(shared, at), "postings")
    full = met.join(coded.drop("label", "dim", "slots"), "rid")
    columns = [*at, "rid", "copies", "code", "factor", "unit"]
    short = full.where(F.col("n") <= block).select(*columns).repartition(*at).sortWithinPartitions(*at).mapInArrow(_short(threshold), _FOUND)
    long = full.where(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / F.lit(block // 2)).cast("int"))
    long = long.withColumn("blk", F.pmod(F.xxhash64("rid", "slot"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    long = long.select(*columns, "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j")).groupBy(
        *at, "i", "j").applyInPandas(_long(threshold), _FOUND)
    found = stage(short.union(long), "links")
    release(coded, met)
    return found


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), v.alias("v"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    takes = F.col("label").isNotNull() & F.coalesce(F.forall("v", sound) & F.exists("v", lambda x: x != 0), F.lit(False))
    # rows that take no part have a second digest of null, which joins with nothing, and a first one that spreads them
    rows = rows.select("vec_id", "label", "v", F.when(takes, F.xxhash64("v")).otherwise(F.xxhash64("vec_id")).alias("d1"),
                       F.when(takes, F.xxhash64(F.lit(7), F.size("v"), "v")).alias("d2"))
    keys = ["label", "d1", "d2"]
    entries = rows.where("d2 is not null").groupBy(*keys).agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    entries = stage(entries.select("*", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("rid")), "entries")
    found = links(entries, threshold)
    comp = components(found.where("b >= 0").select("a", "b")).toDF("rid", "root")
    n = found.where("b < 0").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("others"))
    known = entries.select(*keys, "rid", "copies", "low").join(n, "rid", "left").join(comp, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    low = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = known.join(low, "root").select(*keys, (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("_in"))
    out = rows.select("vec_id", *keys).join(known, keys, "left")
    component = F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))


def op13_vectors(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


_PAIRS = """
    u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
    ok AS (SELECT * FROM u WHERE len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0),
    link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
             WHERE list_cosine_similarity(a.v, b.v) >= 0.93)"""

ORACLE = {"op13_vectors": f"""
WITH RECURSIVE {_PAIRS},
    reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
    low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
    n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, low.component_id, e.vec_id = low.component_id AS kept
FROM embeddings e JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)"""}

QUERIES = {"op13_vectors": op13_vectors}

"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

Every word has a frequency vector: how many of its code points fall into each of ``GROUPS``
letter groups. One inserted code point raises one count by one, a deleted one lowers one, a
replaced one does both (or neither, inside a group). The words of a part of the vocabulary
are arranged in a trie by successive counts. All queries of the part go down the trie
together, depth first: at each level a query takes the children whose count is its own, one
more (spending its surplus of one) or one less (spending its deficit of one). The words of
the leaves reached are verified by their common prefix and suffix.

Parts: the first ``_TOP`` counts of a word name its shard. A query goes to every shard that its
budget can reach, and a pair is looked for from one side only: from the shorter word, or
between equal lengths from the word whose shard comes first. A shard with more than
``_BLOCK`` words or queries is cut by a hash into parts of bounded size that meet pairwise.

Defined cases: null and empty texts have no words; repeated rows count each; a null doc_id is
written as the empty text before the colon; an empty table gives an empty result; other
columns are ignored. Very long runs are words like any other.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import read, release, stage

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Letter groups of about equal weight in Latin-script prose; every other code point is in the last.
GROUPS = ["e", "aq", "ixz", "tw", "nk", "rj", "os", "lcv", "dmp", "ubfghy"]
_TOP = 4          # counts in a shard's name
_BLOCK = 20_000   # words, and queries, worked on in one step
_FRONTIER = 400_000
_SPOIL = 199

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % MIN_LENGTH)


def spoiled(run: str, doc_id: str) -> str:
    """The run, without one code point where its checksum asks for it."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % _SPOIL:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (word, n); texts are read as UTF-8 bytes, of which only A-Z are lower-cased."""
    total: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    crc = zlib.crc32
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            found = Counter(_RUN.findall(text.as_py().lower()))
            head = crc(f"{doc_id}:".encode())
            hit = [w for w in found if crc(w, head) % _SPOIL == 0]
            for w in hit:
                n = found.pop(w)
                total[spoiled(w.decode(), doc_id).encode()] += n
            total.update(found)
            if len(total) > 200_000:
                yield out()
                total.clear()
    if total:
        yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    texts = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    counts = texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= MIN_COUNT) & (F.char_length("word") >= MIN_LENGTH))


_LAST = len(GROUPS)  # the group of every other code point
_GROUP = np.full(256, _LAST, np.int64)  # words hold code points below 256 only
for _k, _letters in enumerate(GROUPS):
    _GROUP[list(_letters.encode())] = _k


def vectors(words: list[bytes]) -> np.ndarray:
    """Counts per letter group of words in Latin-1, a row per word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    at = np.repeat(np.arange(len(words)), size) * (_LAST + 1) + _GROUP[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(at, minlength=len(words) * (_LAST + 1)).reshape(len(words), -1)


class Trie:
    """Words by successive counts: a node is a number per level, its children are found by binary search."""

    def __init__(self, vectors: np.ndarray):
        order = np.lexsort(vectors.T[::-1])
        v = vectors[order].astype(np.int64)
        self.base = int(v.max(initial=0)) + 2
        node, self.keys = np.zeros(len(v), np.int64), []
        for level in range(v.shape[1]):
            keys, node = np.unique(node * self.base + v[:, level], return_inverse=True)
            self.keys.append(keys)
        self.words = order
        self.first = np.searchsorted(node, np.arange(len(self.keys[-1]) + 1))

    def search(self, queries: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) pairs whose vectors differ within the budgets, a surplus of one spent for a deficit; depth first in bounded frontiers.

        With budgets (1, 1) the words found have the query's length, with (1, 0) they are one longer.
        """
        start = np.arange(len(queries))
        todo = [(0, start, np.zeros(len(queries), np.int64), surplus.astype(np.int64), deficit.astype(np.int64))]
        while todo:
            level, q, node, up, down = todo.pop()
            if len(q) > _FRONTIER:
                half = len(q) // 2
                todo += [(level, q[half:], node[half:], up[half:], down[half:]), (level, q[:half], node[:half], up[:half], down[:half])]
                continue
            if level == len(self.keys):
                q, node = q[up == down], node[up == down]
                n = self.first[node + 1] - self.first[node]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[node], n)
                yield np.repeat(q, n), self.words[at]
                continue
            keys, found = self.keys[level], []
            count = queries[q, level]
            for step in (0, 1, -1):
                can = (up > 0) if step > 0 else (down > 0) & (count > 0) if step < 0 else np.ones(len(q), bool)
                can &= count + step < self.base
                want = node[can] * self.base + count[can] + step
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                there = keys[at] == want
                i = np.flatnonzero(can)[there]
                found.append((q[i], at[there], up[i] - (step > 0), down[i] - (step < 0)))
            if sum(len(f[0]) for f in found):
                todo.append((level + 1, *(np.concatenate([f[k] for f in found]) for k in range(4))))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` and ``b`` (code points, zero after the end) differ by exactly one edit; b is as long or one longer."""
    differ = a != b
    replaced = differ.sum(1) == 1
    first = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    late = a[:, :-1] != b[:, 1:]  # what follows an inserted code point
    last = np.where(late.any(1), late.shape[1] - 1 - late[:, ::-1].argmax(1), -1)
    longer = (b != 0).sum(1) > (a != 0).sum(1)
    return np.where(longer, last < first, replaced)


def _verified(queries: list[bytes], words: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``one_edit`` of the pairs (queries[i], words[j]), in steps of bounded size whatever the lengths."""
    hit = np.zeros(len(i), bool)
    size = np.fromiter(map(len, words), np.int64, len(words))[j]
    order = np.argsort(size, kind="stable")
    while len(order):
        n = max(1, min(len(order), 65536, 8_000_000 // int(size[order[min(len(order), 65536) - 1]] + 1)))
        part, order = order[:n], order[n:]
        width = int(size[part].max()) + 1
        q, p = np.unique(i[part], return_inverse=True)
        w, r = np.unique(j[part], return_inverse=True)
        a, b = (np.array([x[k] for k in at], f"S{width}").view(np.uint8).reshape(len(at), width) for x, at in ((queries, q), (words, w)))
        hit[part] = one_edit(a[p], b[r])
    return hit


#: Roles of a row in a part: a word of the trie; a query for words of its length in another shard, for words one longer, for words of its length in its own shard.
_STORED, _EQUAL, _LONGER, _HOME = range(4)


def _near(rows: pd.DataFrame) -> pd.DataFrame:
    """Near pairs (a, b) of a part (word, role)."""
    role = rows["role"].to_numpy()
    text = np.array([w.encode("latin-1") for w in rows["word"]], object)
    words, queries, role = text[role == _STORED].tolist(), text[role != _STORED].tolist(), role[role != _STORED]
    a, b = [], []
    if words and queries:
        for i, j in Trie(vectors(words)).search(vectors(queries), np.ones(len(queries), np.int64), (role != _LONGER).astype(np.int64)):
            hit = np.flatnonzero(_verified(queries, words, i, j))
            for x, y in zip(i[hit].tolist(), j[hit].tolist()):
                if role[x] != _HOME or queries[x] < words[y]:
                    a.append(queries[x].decode("latin-1"))
                    b.append(words[y].decode("latin-1"))
    return pd.DataFrame({"a": a, "b": b}, dtype=object)


def _steps() -> list[tuple[list[int], int]]:
    """Where a query goes, as steps from its own shard, and in which role."""
    out = []
    for up in [None, *range(_TOP)]:
        for down in [None, *range(_TOP)]:
            if up is None or up != down:
                step = [int(k == up) - int(k == down) for k in range(_TOP)]
                if step >= [0] * _TOP:  # the other word looks the other way
                    out.append((step, _EQUAL if any(step) else _HOME))
                if down is None:
                    out.append((step, _LONGER))
    return out


def near_pairs(words: DataFrame, block: int = _BLOCK) -> DataFrame:
    """Every pair (a, b) of near words, each once."""
    count = [F.char_length("word") - F.char_length(F.translate("word", g, "")) for g in GROUPS[:_TOP]]
    base = words.select("word", *[c.alias(f"c{k}") for k, c in enumerate(count)])
    named = lambda step: F.concat_ws(".", *[F.col(f"c{k}") + s for k, s in enumerate(step)])
    can = lambda step: F.greatest(*[F.lit(-s) - F.col(f"c{k}") for k, s in enumerate(step)], F.lit(0)) <= 0
    places = F.array_compact(F.array(*[F.when(can(s), F.struct(F.lit(role).alias("role"), named(s).alias("shard"))) for s, role in _steps()]))
    asked = base.select("word", F.explode(places).alias("to")).select("word", "to.role", "to.shard")
    base = base.select("word", named([0] * _TOP).alias("shard"))
    parts = lambda n: F.ceil(F.count("*") / F.lit(block)).cast("int").alias(n)
    sizes = stage(asked.groupBy("shard").agg(parts("turns")).join(base.groupBy("shard").agg(parts("parts")), "shard"), "shards")
    salt = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int").alias
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias
    stored = base.join(sizes, "shard").select("word", F.lit(_STORED).alias("role"), "shard", salt("parts")("part"), every("turns")("turn"))
    asked = asked.join(sizes, "shard").select("word", "role", "shard", every("parts")("part"), salt("turns")("turn"))
    found = stage(stored.union(asked).groupBy("shard", "part", "turn").applyInPandas(_near, "a string, b string"), "near")
    release(sizes)
    return found


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs``."""
    words = stage(vocabulary(docs), "words")
    found = near_pairs(words)
    both = found.union(found.select("b", "a"))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    # the first in code-point order is the least string: texts are compared by their UTF-8 bytes
    best = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("b"))).alias("best"))
    forms = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                    F.when(-F.col("best.m") >= RATIO * F.col("n"), F.col("best")).alias("best"))
    forms = stage(forms.select("word", "n", "n_near", F.col("best.b").alias("form"), (-F.col("best.m")).alias("form_n")), "forms")
    release(found)
    link = forms.where("form is not null").select("word", F.col("form").alias("next"))
    link = stage(link, "chain")
    while True:  # every step doubles the way gone; counts grow fivefold along it, so ways are short
        on = link.select(F.col("word").alias("next"), F.col("next").alias("after"))
        step = stage(link.join(on, "next", "left").select("word", F.coalesce("after", "next").alias("next"), F.col("after").isNotNull().alias("moved")), "chain")
        done = step.where("moved").isEmpty()
        release(link)
        link = step
        if done:
            break
    root = link.select("word", F.col("next").alias("root"))
    return forms.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variants(spark, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))


QUERIES = {"op12_variants": op12_variants}

"""SentencePiece encoding and decoding: forward filtering, backward sampling over the piece lattice.

A text's lattice has an edge for every vocabulary piece that matches at a position, and a
byte-fallback edge for a character without a piece. A path has probability proportional to
the product of its pieces' weights ``(2 + rank) ** -ALPHA`` (rank: minus the score of a
byte-pair piece). Forward sums are filtered left to right, then one path is drawn right to
left from its exact posterior.

No piece joins a space to what stands before it, and none holds a line break, so the
lattice falls apart at these places: each part (spaces and the run behind them) is filtered
once per Python worker, and all parts of a batch are drawn together. Draws come
from a counter keyed by seed, row key, part and step, on a grid of 2**-24, so a row's ids
do not depend on partitions, batches, retries or other rows.

Decoding maps pieces to bytes (the space mark to a space, byte pieces to their byte) and
drops the one space that encoding puts in front. It gives back the text exactly, also where
the text holds the space mark itself (that goes by byte fallback).

Defined cases: null text gives null ids (query: 0 ids, lossless); an empty text has no ids;
rows with equal key and text get equal ids; the key of a null doc_id is the empty string; an
empty table gives an empty result; other columns are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import mix64, read

ALPHA, SEED = 0.4, 1
_CACHE_PARTS = 400_000
_GRID = 24
_PART = re.compile("\n| *[^ \n]+| +")
_BASE = 0x9E3779B97F4A7C15


def _digest(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * _BASE + ord(c) + 1) % (1 << 64)
    return h


class Lattices:
    """Vocabulary, filtered parts, and the draws."""

    def __init__(self, model: str | None, alpha: float = ALPHA):
        import sentencepiece

        if model is None:
            import public_tokenizers
            model = public_tokenizers.path("piece_bpe_32k.model")
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(p.replace("▁", " ").encode())
                self.pieces[p.replace("▁", " ")] = (i, (2.0 + max(0.0, -sp.get_score(i))) ** -alpha)
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.pieces):
            raise ValueError("pieces of this model join a space to what stands before it, or hold a line break")
        # digests of all beginnings of pieces, sorted, with the piece (or -1) and its weight
        begin = {p[:n]: self.pieces.get(p[:n], (-1, 0.0)) for p in self.pieces for n in range(1, len(p) + 1)}
        found = sorted((_digest(p), i, w) for p, (i, w) in begin.items())
        self.begins = np.array([h for h, _, _ in found], np.uint64)
        self.begin_id, self.begin_weight = np.array([i for _, i, _ in found], np.int64), np.array([w for _, _, w in found])
        self.longest = max(map(len, self.pieces))
        self.byte_weight = float(2 + sp.get_piece_size()) ** -alpha
        n = np.array([len(b) for b in self.bytes_of])
        self.piece_bytes, self.piece_len, self.piece_at = np.frombuffer(b"".join(self.bytes_of), np.uint8), n, np.cumsum(n) - n
        self.clear()

    def clear(self):
        self.parts: dict[str, int] = {}      # part -> its last node
        self.nodes = 0
        self.cum, self.back, self.edge = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.into = np.zeros(0, np.int64)    # by node: its first edge
        self.first = np.zeros(0, bool)       # by node: a part begins here
        self.fallback: dict[str, int] = {}
        self.fall_ids: list[list[int]] = []

    def learn(self, parts: list[str]):
        """Edges and forward sums of new parts, position by position over all of them."""
        size = np.array([len(p) for p in parts], np.int64)
        chars = "".join(parts)
        code = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        total, of = len(code), np.repeat(np.arange(len(parts)), size)
        at = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        left = size[of] - at
        # by edge length and last character: piece, weight (0: no edge)
        width = min(self.longest, int(size.max()))
        piece, weight = np.zeros((width, total), np.int64), np.zeros((width, total))
        alive, h = np.arange(total), np.zeros(total, np.uint64)
        for n in range(1, width + 1):
            fits = left[alive] >= n
            alive, h = alive[fits], h[fits]
            with np.errstate(over="ignore"):
                h = h * np.uint64(_BASE) + code[alive + n - 1] + np.uint64(1)
            k = np.minimum(np.searchsorted(self.begins, h), len(self.begins) - 1)
            hit = self.begins[k] == h
            alive, h, k = alive[hit], h[hit], k[hit]
            whole = self.begin_id[k] >= 0
            piece[n - 1, alive[whole] + n - 1] = self.begin_id[k[whole]]
            weight[n - 1, alive[whole] + n - 1] = self.begin_weight[k[whole]]
        for t in np.flatnonzero(weight[0] == 0).tolist():
            c = chars[t]
            if c not in self.fallback:
                self.fallback[c] = -1 - len(self.fall_ids)
                self.fall_ids.append([self.byte_ids[x] for x in c.encode("utf-8", "surrogatepass")])
            piece[0, t] = self.fallback[c]
            weight[0, t] = self.byte_weight ** len(self.fall_ids[-1 - piece[0, t]])
        # forward sums as mass * 2**scale: products and sums in a fixed order, so equal everywhere
        mass, scale, cum = np.zeros(total), np.zeros(total, np.int32), np.zeros((width, total), np.int32)
        one = float(1 << _GRID)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at))
        for j, (lo, hi) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist())):
            t = order[lo:hi]
            reach = min(width, j + 1)
            flow, shift = weight[:reach, t], np.zeros((reach, len(t)), np.int32)
            for n in range(1, min(reach, j) + 1):
                flow[n - 1] *= mass[t - n]
                shift[n - 1] = scale[t - n]
            top = np.where(flow > 0, shift, np.int32(-(1 << 30))).max(0)
            run = np.cumsum(np.ldexp(flow, np.where(flow > 0, shift - top, 0)), axis=0)
            cum[:reach, t] = np.rint(run / run[-1] * one)
            mass[t], up = np.frexp(run[-1])
            scale[t] = top + up
        t, n = np.nonzero(weight.T)
        node = self.nodes + t + 1 + of[t]
        edges = np.zeros(total + len(parts), np.int64)
        edges[np.arange(total) + 1 + of] = (weight > 0).sum(0)
        self.into = np.concatenate([self.into, len(self.cum) + np.cumsum(edges) - edges])
        self.cum = np.concatenate([self.cum, cum[n, t]])
        self.back = np.concatenate([self.back, node - n - 1])
        self.edge = np.concatenate([self.edge, piece[n, t]])
        begins = np.zeros(total + len(parts), bool)
        begins[np.cumsum(size + 1) - size - 1] = True
        self.first = np.concatenate([self.first, begins])
        self.parts.update(zip(parts, (self.nodes + np.cumsum(size + 1) - 1).tolist()))
        self.nodes += len(begins)

    def encode(self, keys: list[int], texts: list[str | None]) -> list[np.ndarray]:
        """One drawn segmentation per text; keys: unsigned 64-bit row keys."""
        cut = [_PART.findall(" " + t) if t else [] for t in texts]
        if len(self.parts) > _CACHE_PARTS:
            self.clear()
        new = set().union(*cut).difference(self.parts)
        if new:
            self.learn(list(new))
        n = np.array([len(c) for c in cut], np.int64)
        total = int(n.sum())
        at = np.fromiter((self.parts[p] for c in cut for p in c), np.int64, total)
        nth = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        with np.errstate(over="ignore"):
            key = mix64(np.repeat(np.array(keys, np.uint64), n) + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        rows, steps, edges, open_, step = [], [], [], np.arange(total), 0
        while len(open_):
            with np.errstate(over="ignore"):
                u = (mix64(key[open_] + np.uint64(step)) >> np.uint64(64 - _GRID)).astype(np.int32)
            e = self.into[at]
            past = np.flatnonzero(self.cum[e] <= u)
            while len(past):  # a node has few edges
                e[past] += 1
                past = past[self.cum[e[past]] <= u[past]]
            rows.append(open_)
            steps.append(np.full(len(open_), step))
            edges.append(self.edge[e])
            at = self.back[e]
            more = ~self.first[at]
            open_, at, step = open_[more], at[more], step + 1
        if not rows:
            return [np.zeros(0, np.int32) for _ in texts]
        row, drawn = np.concatenate(rows), np.concatenate(edges)
        length = np.bincount(row, minlength=total)
        out = np.empty(len(drawn), np.int64)
        out[np.cumsum(length)[row] - 1 - np.concatenate(steps)] = drawn  # drawn from the right
        ends = np.cumsum(length)[np.cumsum(n) - 1] if total else np.zeros(len(texts), np.int64)
        ends = np.where(np.cumsum(n) > 0, ends, 0)
        result, lo = [], 0
        for hi, k in zip(ends.tolist(), n.tolist()):
            ids = out[lo:hi] if k else out[:0]
            lo = hi if k else lo
            result.append(self._spell(ids))
        return result

    def _spell(self, ids: np.ndarray) -> np.ndarray:
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids.astype(np.int32)
        parts, lo = [], 0
        for i in odd.tolist():
            parts += [ids[lo:i], np.array(self.fall_ids[-1 - ids[i]])]
            lo = i + 1
        return np.concatenate([*parts, ids[lo:]]).astype(np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's UTF-8 bytes."""
        ids = np.asarray(ids, np.int64)
        n = self.piece_len[ids]
        total = int(n.sum())
        raw = self.piece_bytes[np.arange(total) + np.repeat(self.piece_at[ids] - np.cumsum(n) + n, n)].tobytes() if total else b""
        return raw[1:]


_LATTICES: dict[tuple, Lattices] = {}  # one per Python worker


def _lattices(model: str | None, alpha: float) -> Lattices:
    if (model, alpha) not in _LATTICES:
        _LATTICES[model, alpha] = Lattices(model, alpha)
    return _LATTICES[model, alpha]


def row_key(doc_id, seed: int) -> int:
    return xxhash.xxh64_intdigest("" if doc_id is None else str(doc_id), seed)


def encode(docs: DataFrame, seed: int = SEED, alpha: float = ALPHA, model: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                doc, texts = b.column(0).slice(lo, 256), b.column(1).slice(lo, 256).to_pylist()
                ids = _lattices(model, alpha).encode([row_key(d, seed) for d in doc.to_pylist()], texts)
                ids = [None if t is None else i for t, i in zip(texts, ids)]
                yield pa.RecordBatch.from_arrays([doc, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _narrow(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text per row of (doc_id, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            back = _lattices(model, ALPHA).decode
            texts = [None if i is None else back(np.array(i, np.int64)).decode("utf-8", "surrogatepass") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, seed: int = SEED, alpha: float = ALPHA, model: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), lossless (decoding gives the text)."""
    names = ["doc_id", "n_ids", "ids_crc32", "lossless"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                doc, texts = b.column(0).slice(lo, 256), b.column(1).slice(lo, 256).to_pylist()
                lat = _lattices(model, alpha)
                ids = lat.encode([row_key(d, seed) for d in doc.to_pylist()], texts)
                yield pa.RecordBatch.from_arrays([
                    doc, pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                    pa.array([lat.decode(i) == (t or "").encode("utf-8", "surrogatepass") for i, t in zip(ids, texts)])], names)

    return _narrow(docs).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, lossless boolean")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))


QUERIES = {"op9_sentencepiece": op9_sentencepiece}

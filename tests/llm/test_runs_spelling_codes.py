"""Periodic runs, spelling variants and near-duplicate vectors against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkwright.llm import rotated_codes, spelling_trie, word_runs

from .conftest import words

DOCS = "doc_id long, text string"


# ---------------------------------------------------------------- 11 runs

def _runs(x, least=12):
    """(start, period, length) by comparing the sequence with itself at every distance."""
    found = {}
    for p in range(1, len(x) // 2 + 1):
        d = np.diff(np.r_[0, (x[p:] == x[:-p]).astype(int), 0])
        for a, b in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist()):
            if b - a + p >= max(least, 2 * p):
                found.setdefault((a, b - a + p), p)
    return sorted((a, p, n) for (a, n), p in found.items())


def _sequences(seed, count):
    g = np.random.default_rng(seed)
    for k in range(count):
        n = int(g.integers(0, 150))
        if k % 4 == 0:
            yield g.integers(0, int(g.integers(1, 4)), n)
        elif k % 4 == 1:  # a repetition with a few errors
            x = np.tile(g.integers(0, 3, int(g.integers(1, 20))), 40)[:n].copy()
            x[g.integers(0, 150, 3) % max(len(x), 1) if len(x) else []] = 7
            yield x
        elif k % 4 == 2:  # touching stretches of short periods, in and out of step
            yield np.concatenate([np.tile(g.integers(0, 2, int(g.integers(1, 6))), 9)[:int(g.integers(1, 40))] for _ in range(6)])
        else:
            a, b = np.array([0]), np.array([0, 1])
            for _ in range(int(g.integers(3, 9))):
                a, b = b, np.r_[b, a]
            yield np.r_[b, g.integers(0, 2, 3), b]


def test_runs_equal_those_found_at_every_distance():
    for x in _sequences(3, 800):
        start, length, period = word_runs.find_runs(np.asarray(x, np.int64))
        assert list(zip(start.tolist(), period.tolist(), length.tolist())) == _runs(x), x.tolist()


def test_wavelet_tree_successor_and_predecessor():
    g = np.random.default_rng(1)
    values = g.permutation(300)
    tree = word_runs.WaveletTree(values.copy(), 300)
    lo, hi, x = g.integers(0, 300, 500), g.integers(0, 301, 500), g.integers(0, 600, 500)
    lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
    after, before = tree.successor(lo, hi, x), tree.predecessor(lo, hi, x)
    for k in range(500):
        part = values[lo[k]:hi[k]]
        assert after[k] == min(part[part >= x[k]], default=-1) and before[k] == max(part[part < x[k]], default=-1)


def _expected(doc_id, text):
    ws, h = (text or "").encode().split(), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(ws), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    ids = {}
    found = _runs(np.array([ids.setdefault(w, len(ids)) for w in ws], np.int64)) if n else []
    gone = {i for s, p, m in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-r[2], r[0], r[1]), default=None)
    longest = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *longest, digest("".join(f"{s},{m},{p}\n" for s, p, m in found).encode()),
            digest(b" ".join(w for i, w in enumerate(ws) if i not in gone)))


def test_runs_of_documents(spark, monkeypatch):
    texts = {k: words(k, 40 + k) for k in range(60)}
    texts |= {100: "a b " * 30, 101: "x " * 11, 102: "x " * 12, 103: words(1, 7) + " " + " ".join([words(2, 9)] * 3), 104: "", 105: None, 106: " \n"}
    texts |= {107: " ".join(words(5, 30) + " q" * (k % 3) for k in range(12)), 108: "A a a a " * 20, None: "r s t " * 10}
    rows = [*texts.items(), (100, texts[100])]
    got = word_runs.runs(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((_expected(*r) for r in rows), key=str)
    monkeypatch.setattr(word_runs, "_BATCH", 50)  # other batches, same rows
    import pyarrow as pa
    batch = pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] and r[1].encode() for r in rows], pa.binary())], ["doc_id", "text"])
    again = [tuple(r.values()) for b in word_runs._rows(iter([batch])) for r in b.to_pylist()]
    assert sorted(again, key=str) == sorted(map(tuple, got), key=str)


# ---------------------------------------------------------------- 12 spelling

def _edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def _variants(rows):
    import re
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            counts[w if h % 199 else w[:h % len(w)] + w[h % len(w) + 1:]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if _edits(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}

    def last(w):
        return last(form[w]) if w in form else w
    return {(w, form.get(w), last(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def _spelled(seed=2):
    g = np.random.default_rng(seed)
    base = [w for w in {w for w in words(seed, 400).split()} if len(w) >= 6][:60] + ["études", "straßen", "naïveté", "m÷ment×"]
    letters = list("abcdefghilmnorstuzé")
    made = Counter()
    for w in base:
        made[w] += int(g.integers(5, 400))
        for _ in range(6):  # chains of changes, some of them rare
            k, c = int(g.integers(0, len(w))), str(g.choice(letters))
            w = [w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + c + w[k + 1:]][int(g.integers(0, 3))]
            made[w] += int(g.integers(1, 60))
    made["z" * 700] += 6
    made["z" * 701] += 40
    flat = [w.upper() if k % 3 == 0 and w.isascii() else w for k, (w, c) in enumerate(made.items()) for _ in range(c)]
    g.shuffle(flat)
    rows = [(k, " ".join(flat[lo:lo + 25]) + ("7" if k % 2 else ".")) for k, lo in enumerate(range(0, len(flat), 25))]
    return rows + [(5000, None), (5001, ""), (None, " ".join(flat[:40])), (3, rows[3][1]), (3, rows[3][1])]


def test_variants_equal_all_pairs(spark):
    rows = _spelled()
    want = _variants(rows)
    assert len(want) > 150 and sum(r[1] is not None for r in want) > 30
    got = spelling_trie.variants(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("block", [7, 20_000])
def test_parts_of_a_shard_find_every_pair_once(spark, block):
    ws = sorted({w for _, t in _spelled(4) for w in (t or "").lower().replace(".", "").replace("7", "").split() if 5 < len(w) < 40})
    got = spelling_trie.near_pairs(spark.createDataFrame([(w,) for w in ws], "word string"), block).collect()
    want = {(a, b) for a in ws for b in ws if a < b and _edits(a, b)}
    assert len(got) == len(want) and {tuple(sorted(r)) for r in got} == want


# ---------------------------------------------------------------- 13 vectors

def _linked(rows):
    """vec_id-keyed brute force; rows have distinct ids."""
    ok = [(i, np.array(v, float), str(label)) for i, v, label in rows
          if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for a, x, k in ok:
        for b, y, m in ok:
            if a < b and k == m and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def _vectors(seed):
    g = np.random.default_rng(seed)
    x = g.normal(size=(40, 24))
    rows, at = [], 0
    for k, v in enumerate(x):
        for c in range(int(g.integers(1, 9))):
            w = v * g.uniform(0.1, 3) + g.normal(size=24) * (0.0 if c % 3 == 0 else g.uniform(0, 0.35))
            rows.append((at, w.astype(np.float32).tolist(), k % 3))
            at += 1
    rows += [(at + c, rows[0][1], 0) for c in range(70)]  # equal vectors
    return rows


def test_links_equal_all_pairs(spark):
    nan, inf = float("nan"), float("inf")
    rows = _vectors(5)
    rows += [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 24, 0), (1003, [nan] * 24, 0), (1004, [inf] + [1.0] * 23, 0), (1005, [None] + [1.0] * 23, 0),
             (1006, rows[0][1], None), (1007, [1.0, 2.0], 0), (1008, [1.0, 2.0], 0), (1009, [2.0, 4.0], 1), (1010, [1e30, 1e30], 0), (1011, [3.0, 3.0], 0)]
    df = spark.createDataFrame([(i, v, k, 9) for i, v, k in rows], "vec_id long, embedding array<float>, label int, n_links int")
    want = _linked(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rotated_codes.near_duplicates(df).collect()}
    assert sum(n for n, _, _ in want.values()) > 5000
    missed = [i for i in want if got[i] != want[i]]
    assert all(got[i][0] <= want[i][0] for i in want)  # a link may be missed by chance, none is added
    assert len(missed) <= 4, [(i, got[i], want[i]) for i in missed]


def test_large_keys_in_blocks_find_the_same_links(spark):
    entries = spark.createDataFrame([(f"{k}", 24, i, 1 + i % 3, [float(x) for x in v]) for i, v, k in _vectors(6)[:90]], "label string, dim int, rid long, copies long, v array<double>")
    plain, cut = ([tuple(r) for r in rotated_codes.links(entries, block=b).where("b < 0").groupBy("a").sum("n").collect()] for b in (2048, 6))
    assert sorted(plain) == sorted(cut) and len(plain) > 30


def test_recall_at_the_threshold_and_bounds():
    g = np.random.default_rng(9)
    x = rotated_codes.unit(g.normal(size=(3000, 64)))
    e = g.normal(size=x.shape)
    e = rotated_codes.unit(e - (e * x).sum(1, keepdims=True) * x)
    y = 0.93 * x + np.sqrt(1 - 0.93 ** 2) * e  # cosine 0.93
    (a, fa), (b, _) = rotated_codes.encode(x), rotated_codes.encode(y)
    met = (a.view(np.uint16)[:, :rotated_codes.TABLES] == b.view(np.uint16)[:, :rotated_codes.TABLES]).any(1).mean()
    assert met > 0.99
    estimate, bound = rotated_codes.estimates(a, fa, y)
    off = np.diag(estimate) - 0.93
    assert abs(off.mean()) < 0.002 and (np.abs(off) <= bound).all() and bound.max() < 0.2


def test_rows_without_ids_and_empty_tables(spark, no_docs):
    shape = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (None, None, None)], shape)
    got = sorted((tuple(r) for r in rotated_codes.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 0, None, True), (None, 0, None, True)], key=str)
    assert rotated_codes.near_duplicates(spark.createDataFrame([], shape)).count() == 0
    assert word_runs.runs(no_docs).count() == 0 and spelling_trie.variants(no_docs).count() == 0


def test_odd_documents(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = word_runs.runs(odd_docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted((_expected(*r) for r in rows), key=str)
    assert {tuple(r) for r in spelling_trie.variants(odd_docs).collect()} == _variants(rows)

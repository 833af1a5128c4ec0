"""Operators on documents against brute force, and on awkward tables."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkwright.llm import bmw_search, line_dedup, packing_nnls, quality_knn, simhash_bytes, sp_sampling, suffix_dedup, toxicity_bigru
from sparkwright.llm.common import components

from .conftest import words


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def _union(n, links):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x
    for a, b in links:
        at[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, k) for k in range(1, 40)] + [(500, 500), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {k: v for k, v in got.items() if k < 50} == {k: 0 for k in range(40)}
    assert all(got[k] == 100 for k in range(100, 161)) and got[500] == 500


# ---------------------------------------------------------------- 1 quality, 6 toxicity

def test_quality_separates_held_out_documents(spark):
    texts = [words(k, 40) for k in range(160)] + [" ".join([w] * 9) for k in range(40) for w in [words(k + 500, 2)]]
    docs = _docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 160), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = quality_knn.score(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] < 160) for r in held]) > 0.95
    kept = quality_knn.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}


def test_nearest_columns_break_ties_to_the_left():
    cos = np.array([[0.5, 0.9, 0.5, 0.5], [1.0, 1.0, 1.0, 0.0]])
    assert [sorted(r) for r in quality_knn._top(cos, 2).tolist()] == [[0, 1], [0, 1]]


def test_votes_equal_a_plain_loop():
    texts = [words(k, 5 + k % 40) for k in range(quality_knn.NEIGHBOURS + 90)]
    labels = np.array([k % 3 == 0 for k in range(len(texts))], float)
    model = quality_knn.fit_arrays(np.array([quality_knn.terms(t) for t in texts]), labels)
    asked = texts[:5] + [words(900 + k, 30) for k in range(20)] + ["", None]
    z = model.latent(np.array([quality_knn.terms(t) for t in asked]))
    for got, row in zip(model.score(asked), z):
        cos = [float(row @ v) for v in model.vectors]
        near = sorted(range(len(cos)), key=lambda i: (-cos[i], i))[:quality_knn.NEIGHBOURS]
        weight = [max(cos[i], 0.0) ** quality_knn.POWER for i in near]
        wanted = sum(w * labels[i] for w, i in zip(weight, near)) / sum(weight) if sum(weight) > 0 else labels.mean()
        assert got == pytest.approx(wanted, abs=1e-4)


def test_fit_holds_the_sample_once():
    counts = np.random.default_rng(0).integers(0, 3, (1000, quality_knn._TERMS)).astype(np.float32)
    before = counts.copy()
    tracemalloc.start()
    model = quality_knn.fit_arrays(counts, np.arange(1000) % 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * counts.nbytes and (counts == before).all()
    assert np.abs(model.vectors - model.latent(counts)).max() < 1e-5


def test_sample_of_labels_is_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(k % 12, words(k, 20)) for k in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    model = quality_knn.fit(docs, labels, sample=9)
    assert len(model.labels) == 9


@pytest.mark.parametrize("module", [quality_knn, toxicity_bigru])
def test_scores_on_awkward_tables(spark, odd_docs, no_docs, some_labels, module):
    got = module.score(odd_docs, some_labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert module.score(no_docs, some_labels).count() == 0
    assert module.score(odd_docs, some_labels.limit(0)).count() == odd_docs.count()


def test_gradients_of_the_network():
    g = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity_bigru.init(3).items()}
    names = ["alpha", "beta,", "Gamma"]
    ids, owner = toxicity_bigru.window_ids([[1, 2, 3, 2], [3, 1]])
    ids = ids[:, :6]
    weight = g.normal(size=2)

    def loss():
        x = toxicity_bigru.inputs(p, names).astype(np.float64)
        return float(weight @ toxicity_bigru.forward(p, toxicity_bigru.gate_inputs(p, x), ids))
    x = toxicity_bigru.inputs(p, names).astype(np.float64)
    keep = {}
    toxicity_bigru.forward(p, toxicity_bigru.gate_inputs(p, x), ids, keep)
    grad = toxicity_bigru.backward(p, x, names, ids, keep, weight)
    for k in ("wxf", "ub", "wa", "v", "wo", "bo", "bb", "ew", "ec"):
        flat, at = p[k].reshape(-1), int(np.abs(grad[k]).argmax())
        old = flat[at]
        flat[at] = old + 1e-2
        up = loss()
        flat[at] = old - 1e-2
        down = loss()
        flat[at] = old
        assert grad[k].reshape(-1)[at] == pytest.approx((up - down) / 2e-2, rel=0.08, abs=2e-4), k


def test_windows_cover_and_overlap():
    for n in (0, 1, 64, 65, 112, 113, 500):
        starts = toxicity_bigru.windows(n)
        covered = set().union(*(range(s, min(n, s + toxicity_bigru.WINDOW)) for s in starts.tolist()))
        assert covered == set(range(n)) and (np.diff(starts) < toxicity_bigru.WINDOW).all()


def test_toxicity_finds_planted_words(spark):
    bad = ["zorgle", "frimp", "quvax"]
    texts = [words(k, 90) for k in range(300)]
    toxic = [k % 3 == 0 for k in range(300)]
    texts = [" ".join(w + (" " + bad[i % 3] if t and i % 20 == 5 else "") for i, w in enumerate(x.split())) for x, t in zip(texts, toxic)]
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    held = [r for r in toxicity_bigru.score(_docs(spark, texts), labels).collect() if r["held_out"]]
    mean = lambda t: np.mean([r["score"] for r in held if toxic[r["doc_id"]] == t])
    assert mean(True) > mean(False) + 0.3
    assert np.mean([r["predicted"] == int(toxic[r["doc_id"]]) for r in held]) > 0.75


def test_search_holds_few_words_and_few_postings_at_once():
    """500,000 words a worker and 50,000 terms a batch of queries took an executor over its memory."""
    bmw_search._TERMS.clear()
    tracemalloc.start()
    for lo in range(0, 480_000, 1000):
        bmw_search.term_ids(" ".join(f"w{k:x}" for k in range(lo, lo + 1000)))
    words_held = tracemalloc.get_traced_memory()[0]
    bmw_search._TERMS.clear()
    g = np.random.default_rng(3)
    bags = [np.sort(g.choice(40_000, 150, replace=False)).astype(np.uint64) * 2 + 1 for _ in range(4096)]
    shard = bmw_search.Shard(bmw_search.build(list(range(len(bags))), bags), 150.0)
    queries = [(i, 0, np.sort(g.choice(40_000, 4000, replace=False)).astype(np.uint64) * 2 + 1, np.ones(4000)) for i in range(24)]
    batches = bmw_search.batches_of([(a, b, t.tobytes(), w.tobytes()) for a, b, t, w in queries])
    base = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    for batch in batches:
        shard.search(batch, 10)
    peak = tracemalloc.get_traced_memory()[1] - base
    tracemalloc.stop()
    one = [shard.top(t, w, 10) for _, _, t, w in queries]
    got = [x for b in batches for x in zip(b.ids, b.scores)]
    assert all((a[0] == b[0]).all() and np.allclose(a[1], b[1]) for a, b in zip(one, got))
    assert words_held < 40e6 and peak < 40e6, (words_held, peak)


def test_search_goes_over_few_postings(monkeypatch):
    """all words of every candidate were added up, and each block of a term by itself, in several passes."""
    g = np.random.default_rng(9)
    bags = [np.sort(g.choice(40_000, 900, replace=False)).astype(np.uint64) * 2 + 1 for _ in range(1024)]
    shard = bmw_search.Shard(bmw_search.build(list(range(len(bags))), bags), 900.0)
    queries = [(i, 0, np.sort(g.choice(40_000, 40, replace=False)).astype(np.uint64) * 2 + 1, np.ones(40)) for i in range(30)]
    ragged, made = bmw_search._ragged, []
    monkeypatch.setattr(bmw_search, "_ragged", lambda start, count: (made.append(int(count.sum())), ragged(start, count))[1])
    found = [shard.top(t, w, 10) for _, _, t, w in queries]
    counts = np.diff(shard.ends, prepend=0)
    postings = sum(int(counts[np.isin(shard.terms, t)].sum()) for _, _, t, _ in queries)
    assert sum(made) <= 2.1 * postings  # bounds, then scores
    for (_, _, t, w), (ids, scores) in zip(queries, found):
        full = sorted((-sum(2.2 / (1 + 1.2) for _ in np.intersect1d(b, t)), d) for d, b in enumerate(bags))[:10]
        assert ids.tolist() == [d for _, d in full] and np.allclose(scores, [-s for s, _ in full])


def test_batches_for_python_are_small(spark):
    """batches of up to 64 MB stood in the JVM and in each worker; pipeline stages ran without the session's settings."""
    import corpus_pipeline
    from sparkwright.session import configure

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        corpus_pipeline.suffix_dedup(spark, _docs(spark, ["a"]), "")
        assert spark.conf.get(key) in ("8m", "8388608b")
        made = spark.range(40, numPartitions=1).select(F.expr("cast(repeat('x', 3000000) as binary) AS b")).mapInArrow(sizes, "n long")
        assert max(r["n"] for r in made.collect()) <= 12_000_000
        spark.conf.set(key, "1m")
        configure(spark)
        assert spark.conf.get(key) in ("1m", "1048576b")  # a setting of the caller stays
    finally:
        spark.conf.set(key, was)


# ---------------------------------------------------------------- 2 lines

def _shingles(line):
    b = line.encode()
    return {b[i:i + 8] for i in range(max(1, len(b) - 7))}


def test_lines_against_brute_force(spark):
    g = np.random.default_rng(4)
    base = [words(k, 25) for k in range(40)]
    lines = base + [" ".join(w if g.random() > 0.03 else "zz" for w in base[k % 40].split()) for k in range(160)] + base[:20]
    lines += [words(900 + k, 4) for k in range(30)] + ["", "  "]
    order = g.permutation(len(lines))
    texts = ["\n".join(lines[i] for i in order[lo:lo + 6]) for lo in range(0, len(lines), 6)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(_docs(spark, texts)).collect()}
    seen = list(dict.fromkeys(x for t in texts for x in t.split("\n") if x.strip(" ")))
    sets = [_shingles(x) for x in seen]
    links = [(i, j) for i in range(len(seen)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = dict(zip(seen, _union(len(seen), links)))
    done, want = set(), {}
    for d, t in enumerate(texts):
        kept = []
        for x in t.split("\n"):
            if not x.strip(" ") or root[x] not in done:
                kept.append(x)
                done.add(root.get(x))
        want[d] = "\n".join(kept)
    same = sum(got[d] == want[d] for d in want)
    assert same >= len(want) - 1 and sum(map(len, got.values())) >= sum(map(len, want.values()))


def test_lines_that_differ_at_the_end_share_a_band(spark):
    g = np.random.default_rng(8)
    digits = lambda n: "".join(map(str, g.integers(0, 10, n)))
    forms = [lambda k: f"Order confirmed for customer {digits(10)}", lambda k: f"{words(k, 6)} call +49 30 {digits(8)}",
             lambda k: f"{words(k, 7)} due on 2026-{g.integers(10, 13)}-{g.integers(10, 29)}", lambda k: f"{words(k, 7)} price {digits(3)}.{digits(2)}"]
    first = [forms[k % 4](k) for k in range(200)]
    pairs = [(x, x[:-1] + str((int(x[-1]) + 1) % 10)) for x in first]
    assert all(len(_shingles(a) & _shingles(b)) >= 0.8 * len(_shingles(a) | _shingles(b)) for a, b in pairs)
    assert _met(spark, pairs) >= 0.97


def _met(spark, pairs, cut=True):
    """Share of the pairs of lines that have a band key in common."""
    lines = spark.createDataFrame([(2 * i + j, x) for i, pair in enumerate(pairs) for j, x in enumerate(pair)], "node long, line string")
    keys = {r["node"]: set(r["keys"]) for r in line_dedup._sketches(lines, ["node"], cut).collect()}
    return np.mean([bool(keys.get(2 * i, set()) & keys.get(2 * i + 1, set())) for i in range(len(pairs))])


def test_cut_sketches_meet_like_whole_ones(spark):
    g = np.random.default_rng(12)
    pairs = []
    for k in range(300):
        a = words(k, 60 + k % 60).split()
        b = [("qq" if g.random() < 0.02 else w) for w in a]
        pairs.append((" ".join(a), " ".join(b)))
    pairs = [p for p in pairs if 0.8 <= len(_shingles(p[0]) & _shingles(p[1])) / len(_shingles(p[0]) | _shingles(p[1])) < 0.9]
    assert len(pairs) > 50 and min(len(_shingles(a)) for a, _ in pairs) > line_dedup._SKETCH
    assert _met(spark, pairs) >= 0.97 and _met(spark, pairs, cut=False) >= 0.97


def test_lines_of_few_distinct_shingles_are_linked(spark):
    long = "ab " * 400
    docs = _docs(spark, [long, "first\n" + long + "a", words(1, 30) + "\n" + long[1:]])
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {0: long, 1: "first", 2: words(1, 30)}


def test_prefixes_lose_no_pair(spark):
    g = np.random.default_rng(6)
    base = words(1, 40).split()
    lines = [" ".join(w if g.random() > share else words(50 + i, 1) for w in base) for i, share in enumerate([0.0, 0.02, 0.03, 0.05, 0.1, 0.3, 0.5] * 8)]
    lines = list(dict.fromkeys(lines)) + ["x", "xy", "12345678", "123456789"]
    sets = [_shingles(x) for x in lines]
    df = spark.createDataFrame([(i, x, len(sets[i])) for i, x in enumerate(lines)], "node long, line string, width int")
    left = df.select(F.lit(1).alias("key"), "node", F.col("node").alias("comp"))
    got = {tuple(r) for r in line_dedup._apart(line_dedup._prefixes(left, df, 0.8), 0.8).collect()}
    want = {(i, j) for j in range(len(lines)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert want and want <= got and len(got) < len(lines) * (len(lines) - 1) / 4


def test_pairs_of_lines_are_decided_by_their_shingles_alone(spark):
    a, b, far = words(1, 12), words(1, 12)[:-1] + "9", words(2, 12)
    docs = _docs(spark, [a, b, far])
    first = docs.select("doc_id", *line_dedup._digest(F.col("doc_id"), F.col("text")), F.lit(0).alias("pos"))
    width = {i: len(_shingles(x)) for i, x in enumerate((a, b, far))}
    sig = F.array(F.col("doc_id").cast("int"))  # signatures that agree in nothing
    distinct = first.select(F.col("doc_id").alias("node"), F.struct("r1", "r2", "pos").alias("first"), sig.alias("sig"), F.create_map(
        *(F.lit(int(x)) for kv in width.items() for x in kv))[F.col("doc_id").cast("int")].alias("width"))
    whole = docs.select(*line_dedup._digest(F.col("doc_id"), F.col("text")), "text")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long")
    texts = line_dedup._texts(distinct.select("node"), distinct, whole)
    sets = texts.join(distinct.select("node", "width"), "node")
    assert [tuple(r) for r in line_dedup._links(pairs, sets, 0.8).collect()] == [(0, 1)]


def test_open_bands_pair_lines_of_like_sizes_only(spark):
    width = [1, 2, 4, 5, 8, 10, 16, 20, 25, 64, 80, 81, 100, 1000, 1250, 1251]
    left = spark.createDataFrame([(k, i, i // 2, w) for k in (1, 2) for i, w in enumerate(width)], "key long, node long, comp long, width int")
    got = sorted(tuple(r) for r in line_dedup._apart(left, 0.8).collect())
    assert got == [(i, j) for i in range(len(width)) for j in range(i + 1, len(width)) if i // 2 != j // 2 and width[i] * 10 >= width[j] * 8]


def test_open_bands_pair_only_lines_that_may_be_alike(spark):
    """Lines that share half of their text: as pairs of a band they grew with the square of its size (F1, F2)."""
    shared = words(1, 30)
    lines = [shared + " " + words(100 + k, 30) for k in range(120)]
    lines += [x[:-3] + "qqq" for x in lines[:20]] + [words(900 + k, 4) for k in range(10)] + ["x", "12345678", "ab " * 300]
    sets = [_shingles(x) for x in lines]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "node long, line string")
    sizes = line_dedup._odd_sketches(df)
    assert {r["node"]: r["width"] for r in sizes.collect()} == {i: len(s) for i, s in enumerate(sets)}
    left = sizes.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("key"), F.col("node").alias("comp"), "*")
    got = {tuple(r) for r in line_dedup._apart(left, 0.8).collect()}
    want = {(i, j) for j in range(len(lines)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(want) >= 20 and want <= got and len(got) < 2 * len(want)
    assert {tuple(r) for r in line_dedup._links(spark.createDataFrame(list(got), "a long, b long"), sizes.join(df, "node"), 0.8).collect()} == want


def test_lines_of_repeated_documents_are_linked(spark):
    """A document that stands twice gives its lines twice, which must not double or cancel their odd sketches."""
    a, b = words(1, 40), words(2, 300)
    near = lambda x: x[:-1] + "9"
    rows = [(1, a), (1, a), (2, near(a) + "\nrest"), (3, near(b)), (3, near(b)), (3, near(b)), (4, near(b)[1:]), (4, near(b)[1:])]
    got = sorted(tuple(r) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, a), (1, a), (2, "rest"), (3, near(b)), (3, near(b)), (3, near(b)), (4, ""), (4, "")]
    texts = spark.createDataFrame([(1, a), (1, a), (2, b)], "node long, line string")
    assert sorted(tuple(r) for r in line_dedup._odd_sketches(texts).collect()) == sorted(tuple(r) for r in line_dedup._odd_sketches(texts.distinct()).collect())


def test_lines_on_awkward_tables(spark, odd_docs, no_docs):
    got = line_dedup.dedup_lines(odd_docs)
    assert got.columns == odd_docs.columns and got.count() == odd_docs.count()
    by = {r["doc_id"]: r["text"] for r in got.collect()}
    assert by[1] is None and by[2] == "" and by[3] == " \n\t" and by[5] == words(1, 60) and by[6] == ""
    assert by[8] == words(3, 80) + "\n" + words(4, 40)
    assert line_dedup.dedup_lines(no_docs).count() == 0


# ---------------------------------------------------------------- 4 SimHash

def _brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def test_simhash_against_brute_force(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = simhash_bytes.near_duplicates(odd_docs).collect()
    fp = [_brute_fingerprint(r["text"]) for r in rows]
    links = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4]
    root = _union(len(fp), links)
    low = {c: min((r["doc_id"] for r, k in zip(rows, root) if k == c and r["doc_id"] is not None), default=None) for c in root}
    key = lambda t: (str(t[0]), t[1])
    want = sorted(((r["doc_id"], f"{x:016x}", low[c]) for r, x, c in zip(rows, fp, root)), key=key)
    assert sorted(map(tuple, got), key=key) == want
    kept = simhash_bytes.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(v for v in low.values())


@pytest.mark.parametrize("block", [2048, 16])
def test_near_fingerprints_in_large_postings(spark, block):
    g = np.random.default_rng(1)
    centre = int(g.integers(0, 1 << 62))
    fps = {centre}
    while len(fps) < 150:  # random walks around a centre: chains of links, not one ball
        x = int(g.choice(list(fps)))
        fps.add(x ^ sum({1 << int(k) for k in g.integers(0, 40, g.integers(1, 7))}))
    fps = sorted(fps | {int(x) for x in g.integers(0, 1 << 62, 100)})
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    edges = simhash_bytes.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, block).collect()
    at = {x: i for i, x in enumerate(signed)}
    want = _union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert _union(len(fps), [(at[r["a"]], at[r["b"]]) for r in edges]) == want


def test_postings_are_not_broadcast(spark, tmp_path):
    """Spark sizes exploded rows like the table they come from: 20,000 fingerprints of 160 KB, 700,000 postings."""
    spark.range(20_000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fp"))
    posted = simhash_bytes._postings(spark.read.parquet(str(tmp_path / "fp")))
    posted.collect()
    plan = posted._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


# ---------------------------------------------------------------- 7 search

def test_search_against_brute_force(spark, odd_docs, no_docs):
    docs = odd_docs.where("doc_id is not null")
    got = bmw_search.search(docs, docs.where("doc_id % 2 = 0"), 3).collect()
    rows = [(r["doc_id"], [y for y in (w.strip(bmw_search._MARKS) for w in (r["text"] or "").lower().split()) if y]) for r in docs.collect()]
    rows = [r for r in rows if r[1]]
    n, mean = len(rows), np.mean([len(t) for _, t in rows])
    df = Counter(w for _, t in rows for w in set(t))
    for q, bag in {q: t for q, t in rows if q % 2 == 0}.items():
        scored = []
        for d, t in rows:
            c = Counter(t)
            s = sum(k * np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w, k in Counter(bag).items() if w in c)
            scored += [(-s, d)] if s > 0 else []
        mine = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [d for _, d, _ in mine] == [d for _, d in sorted(scored)[:3]]
        assert np.allclose([s for _, _, s in mine], [-s for s, _ in sorted(scored)[:3]])
    assert bmw_search.search(no_docs, no_docs).count() == 0


def test_pruned_shard_equals_full_scoring():
    g = np.random.default_rng(2)
    bags = [np.sort(g.zipf(1.3, g.integers(5, 60)).astype(np.uint64) % 300 + 1) for _ in range(500)]
    shard = bmw_search.Shard(bmw_search.build(list(range(500)), bags), 30.0)
    terms = np.unique(bags[7])
    ids, scores = shard.top(terms, np.linspace(1, 3, len(terms)), 10)
    weight = dict(zip(terms.tolist(), np.linspace(1, 3, len(terms))))
    full = [(-sum(weight[t] * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(b) / 30)) for t, k in Counter(b.tolist()).items() if t in weight), d) for d, b in enumerate(bags)]
    assert ids.tolist() == [d for _, d in sorted(full)[:10]] and np.allclose(scores, [-s for s, _ in sorted(full)[:10]])


def test_a_task_gives_k_rows_a_query_over_all_its_shards():
    g = np.random.default_rng(5)
    bags = [np.sort((g.zipf(1.3, g.integers(5, 60)).astype(np.uint64) % 300 + 1) << 55 | 1) for _ in range(900)]
    bags[600] = bags[601] = bags[10]  # ties between shards
    parts = [bmw_search.build(list(range(lo, lo + 300)), bags[lo:lo + 300]) for lo in (600, 0, 300)]
    rows = [pa.RecordBatch.from_arrays([pa.array([x[c].tobytes()], pa.binary()) for c in bmw_search._KINDS], list(bmw_search._KINDS)) for x in parts]
    asked = []
    for d in range(0, 900, 6):
        terms = np.unique(bags[d])
        asked.append((d, -d, terms.tobytes(), g.uniform(0.5, 3, len(terms)).tobytes()))
    held = type("Held", (), {"value": asked})
    out = pa.Table.from_batches(list(bmw_search._search_rows(held, 30.0, 5)(iter(rows)))).to_pylist()
    assert len(out) <= 5 * len(asked)
    got = defaultdict(list)
    for r in out:
        got[r["q1"]].append((r["doc_id"], r["score"]))
    for q1, _, terms, weights in asked:
        weight = dict(zip(np.frombuffer(terms, np.uint64).tolist(), np.frombuffer(weights).tolist()))
        full = [(-sum(weight[t] * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(b) / 30)) for t, k in sorted(Counter(b.tolist()).items()) if t in weight), d) for d, b in enumerate(bags)]
        full = sorted((round(s, 9), d) for s, d in full if s < 0)[:5]
        assert [(round(-s, 9), d) for d, s in got[q1]] == full


# ---------------------------------------------------------------- 8 suffix arrays

def test_suffix_array_of_small_strings():
    g = np.random.default_rng(3)
    for _ in range(2000):
        t = g.integers(0, g.integers(1, 5), g.integers(0, 24)).tolist()
        assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def _brute_cut(texts):
    b = [(t or "").encode() for t in texts]
    n = Counter(x[i:i + 200] for x in b for i in range(len(x) - 199))
    out = []
    for x in b:
        mark = np.zeros(len(x) + 1, int)
        for i in range(len(x) - 199):
            if n[x[i:i + 200]] > 1:
                mark[i] += 1
                mark[i + 200] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out.append((len(x), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_groups_of_one_suffix_are_not_sorted(monkeypatch):
    """Most groups hold one suffix: they need no order, no count and no new groups."""
    calls = []
    monkeypatch.setattr(suffix_dedup, "sorted", lambda x, **k: calls.append(1) or sorted(x, **k), raising=False)
    text = np.random.default_rng(3).permutation(400).tolist()
    assert suffix_dedup.suffix_array(text) == sorted(range(400), key=text.__getitem__)
    assert not calls


def test_repeated_windows_of_several_sets():
    """Sets with cores of different sizes in one array; texts without a whole window; a window in all texts, in two, in one."""
    g = np.random.default_rng(4)
    side = lambda n: bytes(g.integers(0, 3, n, np.uint8))
    sets = [list({(side(g.integers(0, 12)), side(g.integers(0, 12)), core) for _ in range(n)}) for core, n in ((190, 60), (188, 1), (195, 40), (200, 5), (190, 2))]

    def windows(left, right, core):
        return [(j, left[j:] + b"|" + right[:200 - core - len(left) + j]) for j in range(len(left) + 1) if 0 <= 200 - core - len(left) + j <= len(right)]
    for members, found in zip(sets, suffix_dedup.repeated_windows(sets), strict=True):
        times = Counter((len(x) and x.index(b"|"), x) for m in members for _, x in windows(*m))
        assert found == [[j for j, x in windows(*m) if times[x.index(b"|"), x] > 1] for m in members]


@pytest.mark.parametrize("limit", [20_000, 1])
def test_repeated_strings_against_brute_force(spark, odd_docs, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "_SET", limit)
    rows = odd_docs.select("doc_id", "text").collect()
    passage = words(77, 60)
    extra = [words(300 + k, k) + passage[k:len(passage) - 3 * k] + words(400 + k, 5) for k in range(12)] + ["ab" * 300, "ab" * 90 + "c" + "ab" * 110]
    docs = odd_docs.unionByName(_docs(spark, extra).withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    got = suffix_dedup.cut(docs, counts=True).select("text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "doc_id").collect()
    want = _brute_cut([r["text"] for r in rows] + extra)
    ids = [r["doc_id"] for r in rows] + [1000 + k for k in range(len(extra))]
    key = lambda t: (str(t[0]), *t[1:])
    assert sorted(((r["doc_id"], *tuple(r)[1:5]) for r in got), key=key) == sorted(((i, *w) for i, w in zip(ids, want)), key=key)


def test_cut_keeps_columns_and_nulls(odd_docs, no_docs):
    got = suffix_dedup.cut(odd_docs)
    assert got.columns == odd_docs.columns and got.where("doc_id = 1 and text is null").count() == 1
    assert suffix_dedup.cut(no_docs).count() == 0


# ---------------------------------------------------------------- 9 pieces, 10 packing

def test_pieces_round_trip_and_repeat(spark, odd_docs, no_docs):
    docs = odd_docs.union(odd_docs.limit(0)).withColumn("doc_id", F.monotonically_increasing_id())
    one, two = sp_sampling.encode(docs, seed=5), sp_sampling.encode(docs.repartition(3), seed=5)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)
    back = {r["doc_id"]: r["text"] for r in sp_sampling.decode(one).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert sp_sampling.encode(no_docs).count() == 0
    assert {r["lossless"] for r in sp_sampling.digest(docs).collect()} == {True}
    marks = sp_sampling.Lattices(None)
    for t in ("a ▁ b▁", "  two  ", "\n\n x\t", "漢 字 ①"):
        assert marks.decode(marks.encode([1], [t])[0]) == t.encode()


def test_pieces_follow_the_posterior():
    lat = sp_sampling.Lattices(None, 0.3)
    draws = Counter(tuple(x.tolist()) for x in lat.encode(list(range(40_000)), ["then"] * 40_000))
    weights = {}

    def walk(i, w, ids, s=" then"):
        if i == len(s):
            weights[tuple(ids)] = w
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in lat.pieces:
                e, x = lat.pieces[s[i:j]]
                walk(j, w * x, [*ids, e])
    walk(0, 1.0, [])
    total = sum(weights.values())
    assert set(draws) <= set(weights)
    assert all(abs(draws[k] / 40_000 - w / total) < 0.012 for k, w in weights.items())


def test_words_encode_like_the_tokenizer():
    from tokenizers import Tokenizer
    import public_tokenizers
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["It's THE end, isn't it?! <|endoftext|> x<|startoftext|>y", "Éá ÀÖ ﬁ İı Σς 12a3 a_b--c...", "\x1cq\x1d r s​t", "", " ", "漢字かな😀 ñandú's"]
    assert [i.tolist() for i in packing_nnls.WordIds(None).encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_equal_pretokens_are_encoded_once():
    from tokenizers import Tokenizer
    import public_tokenizers
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    g = np.random.default_rng(4)
    letters, marks = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ\u00c4\u00e9\u00df"), list("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
    texts = [" ".join("".join(g.choice(letters, g.integers(0, 12))) + "".join(g.choice(marks, g.integers(0, 4))) for _ in range(200)) for _ in range(5)]
    texts += ["The the, THE, the", "dann's 7 <|endoftext|>, <|endoftext|>"]
    enc = packing_nnls.WordIds(None)
    learnt = []
    enc.learn = lambda parts, f=enc.learn: learnt.extend(parts.to_pylist()) or f(parts)
    for some in ([None, texts[0]], texts, pa.array(texts[::-1]), []):
        assert [i.tolist() for i in enc.encode(some)] == [tok.encode(t or "", add_special_tokens=False).ids for t in (some if isinstance(some, list) else some.to_pylist())]
    assert len(learnt) == len(set(learnt)) and {"the", ",", "dann's"} <= set(learnt) and not {"The", "THE,"} & set(learnt)


def test_plan_uses_every_tail_once():
    g = np.random.default_rng(6)
    for top in (3, 40, 64):
        hist = np.bincount(g.integers(1, top, 700), minlength=65)
        patterns = packing_nnls.plan(hist, 64)
        used = np.zeros(65, int)
        for use, k in patterns:
            assert sum(a * n for a, n in use) <= 64 and k > 0
            for a, n in use:
                used[a] += n * k
        assert (used == hist).all()
        assert sum(k for _, k in patterns) <= 1.06 * (np.arange(65) @ hist) / 64 + 1


def test_packing_on_awkward_tables(odd_docs, no_docs):
    import pandas as pd
    got = packing_nnls.pack(odd_docs, window=256).toPandas()
    whole = packing_nnls.WordIds(None)
    texts = odd_docs.select("doc_id", "text").collect()
    want = []
    for r in texts:
        ids = np.append(whole.encode([r["text"]])[0], np.uint32(2)).astype("<u4")
        want += [(str(r["doc_id"]), s, len(ids[s:s + 256]), zlib.crc32(ids[s:s + 256].tobytes()), len(ids)) for s in range(0, len(ids), 256)]
    mine = [(str(None if pd.isna(d) else int(d)), *map(int, v)) for d, *v in got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].values.tolist()]
    assert sorted(mine) == sorted(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 256
    assert packing_nnls.pack(no_docs).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    g = np.random.default_rng(0)
    docs = _docs(spark, [words(k, 50) for k in range(60)] + [words(3, 50)] * 3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(g.random() < 0.9), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.collect(), docs.schema)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "suffix_dedup", "packing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= now.count()

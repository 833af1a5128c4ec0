"""Fuzzy line dedup: MinHash over character shingles, on DataFrame functions alone.

A line's shingles are its 8-byte windows (UTF-8; a shorter line is one shingle), hashed with
xxhash64 as rows in generated code. One-permutation MinHash: 24 bins by the hash's remainder,
the minimum of each bin; three bins make a band key, eight keys a line. Only the least hashes
(96 expected) reach the bins; a line that has too few distinct ones among them is sketched
again from all. Equal lines are one entry (128-bit digest), so copies never meet in a band. Every pair from the bands is verified on the shingle sets, except
where their exact sizes or their odd sketches rule the similarity out.

Inside a band the entries are not paired with each other. Every entry is compared with the
band's centre (its most repeated line); the exact Jaccard similarity of the shingle sets
decides; distributed union-find joins the links. Bands that still hold several components
get further centres. Entries of different components that are left meet inside their band, where
sizes and odd sketches allow the similarity. A bit of an odd sketch is the parity of the distinct
shingles whose hash falls there: what two lines share cancels out, so the bits that differ never
outnumber the shingles that only one of them has. No link of a band is lost, neither to the order
of comparison nor to this bound.

One line of each component stays: the first occurrence by doc_id (nulls last), row digest and
position. Blank lines are neither compared nor removed. Documents keep their row, lines
are cut at "\\n" and joined again with it.

Defined cases: a null text stays null; an empty text has one blank line; rows that agree in
doc_id and text are one document that stands several times, and all of them keep what it
keeps; an empty table gives an empty result; other columns pass through, also under names
used here. Lines and texts of any length are hashed whole.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import components, read, release, stage

SHINGLE, SIMILARITY = 8, 0.8
_BINS, _ROWS = 24, 3
_SKETCH = 96               # least hashes looked at, as expected count; a line of fewer shingles shows all
_FILLED = 16               # a cut sketch with fewer bins filled is made again from all hashes
_WORDS = 16                # of 64 bits in an odd sketch
_STARS = 3                 # rounds of centres before the remaining pairs; after the first one only
_CROWDED = 2000            # while a band of more entries is open; fewer make at most 2 million comparisons of odd sketches
_BROADCAST_ROWS = 500_000  # rows of at most some 40 bytes; beyond it the join shuffles


def _shingles(line: str) -> str:
    return (f"transform(array(encode({line}, 'UTF-8')), b -> transform(sequence(1, greatest(octet_length(b) - {SHINGLE - 1}, 1)), "
            f"i -> xxhash64(substring(b, i, {SHINGLE}))))[0]")


def _sketches(lines: DataFrame, by: list[str], cut: bool = True) -> DataFrame:
    """(*by, keys, filled, was_cut) of ``lines(*by, line)``, one row per ``by``, which names the line: band keys of its one-permutation MinHash.

    The shingles are rows, hashed and reduced in generated code; only minima move. With ``cut`` only
    hashes under ``_SKETCH`` in the line's count of shingles reach the bins, which leaves the minimum
    of every bin that keeps one.
    """
    whole = 9223372036854775807
    n = f"greatest(octet_length(b) - {SHINGLE - 1}, 1)"
    limit = f"if(n <= {_SKETCH}, {whole}L, cast(-9.223372036854775808E18D + 1.8446744073709552E19D * {_SKETCH} / n as bigint))" if cut else f"{whole}L"
    x = lines.select(*by, F.expr("cast(line as binary)").alias("b")).select(*by, "b", F.expr(n).alias("n"))
    x = x.select(*by, "b", F.expr(limit).alias("top"), F.explode(F.expr("sequence(1, n)")).alias("i"))
    x = x.select(*by, "top", F.expr(f"xxhash64(substring(b, i, {SHINGLE}))").alias("h")).where("h <= top")
    x = x.select(*by, "top", F.expr("cast(shiftright(h, 32) as int)").alias("h"), F.expr(f"cast(pmod(h, {_BINS}) as int)").alias("bin"))
    made = x.groupBy(*by).agg(F.bool_or(F.col("top") < whole).alias("was_cut"), *(F.expr(f"min(h) FILTER (WHERE bin = {k})").alias(f"m{k}") for k in range(_BINS)))
    bands = [[f"m{k}" for k in range(lo, lo + _ROWS)] for lo in range(0, _BINS, _ROWS)]
    # a null is skipped by the hash, so bins are told apart by their number
    keys = [F.when(F.coalesce(*band).isNotNull(), F.xxhash64(*(x for m in band for x in (F.lit(int(m[1:])), F.col(m))))) for band in bands]
    filled = sum((F.when(F.col(f"m{k}").isNotNull(), 1).otherwise(0) for k in range(_BINS)), F.lit(0))
    return made.select(*by, F.array_compact(F.array(*keys)).alias("keys"), filled.alias("filled"), "was_cut")


def _weak() -> Column:
    """Lines of many equal shingles: the cut left too few of the distinct ones (or none, then there is no sketch)."""
    return F.col("filled").isNull() | (F.col("was_cut") & (F.col("filled") < _FILLED))


def _may_reach(a: str, b: str, similarity: float) -> str:
    """Whether sets of these sizes can have the Jaccard similarity: it is at most the smaller size over the larger."""
    return f"least({a}, {b}) >= {similarity}D * greatest({a}, {b}) - 1e-9"


def _bits(sets: DataFrame) -> list[str]:
    """Columns of the odd sketch, if the table has them."""
    return [c for c in (f"o{k}" for k in range(_WORDS)) if c in sets.columns]


def _odd_sketches(texts: DataFrame) -> DataFrame:
    """(node, width, o0, ...) of ``texts(node, line)``: count of distinct shingles, and parities of those that fall on each bit."""
    # repeated documents give a line more than once: each row is counted by itself, and one is kept
    x = texts.select("node", "line", F.monotonically_increasing_id().alias("row"))
    # no array is empty; a plain explode would make each twice, to ask that
    x = x.select("node", "row", F.expr(f"explode_outer(array_distinct({_shingles('line')}))").alias("h"))
    x = x.select("node", "row", F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"), F.expr(f"cast(pmod(shiftright(h, 6), {_WORDS}) as int)").alias("word"))
    rows = x.groupBy("node", "row").agg(F.count("*").cast("int").alias("width"), *(F.expr(f"coalesce(bit_xor(bit) FILTER (WHERE word = {k}), 0L)").alias(f"o{k}") for k in range(_WORDS)))
    return rows.groupBy("node").agg(*(F.max(c).alias(c) for c in ("width", *_bits(rows))))  # copies are equal


def _may_differ(bits: list[str], a: str, b: str, similarity: float) -> str:
    """Whether odd sketches (columns with these endings) of sets of sizes ``w{a}``, ``w{b}`` can have the Jaccard similarity.

    It asks that no more than (1 - s) / (1 + s) of the sizes' sum stands in one set alone.
    """
    differ = " + ".join(f"bit_count({c}{a} ^ {c}{b})" for c in bits)
    return f"{differ} <= {(1 - similarity) / (1 + similarity)}D * (w{a} + w{b}) + 1e-6"


def _jaccard(a: str, b: str, bound: float) -> str:
    """Whether the Jaccard similarity of two arrays without repeats is at least ``bound``; each is worked out once."""
    return (f"transform(array(struct({a} as a, {b} as b)), s -> {1 + bound}D * size(array_intersect(s.a, s.b)) "
            f">= {bound}D * (size(s.a) + size(s.b)) - 1e-9)[0]")


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast a staged table of narrow rows when its row count is within the bound."""
    return F.broadcast(df) if df.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS else df


def _with(pairs: DataFrame, nodes: DataFrame, **columns: str) -> DataFrame:
    """Pairs (a, b) with columns of either end, under the given names and ``_a`` or ``_b``."""
    for end in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(end), *(F.col(c).alias(f"{name}_{end}") for name, c in columns.items())), end)
    return pairs


def _texts(nodes: DataFrame, distinct: DataFrame, whole: DataFrame) -> DataFrame:
    """(node, line) of the nodes, fetched from the documents of their first places."""
    # rows that agree in doc_id and text give a line more than once, all the same
    wanted = distinct.join(nodes, "node").select("node", F.col("first.r1"), F.col("first.r2"), F.col("first.pos"))
    needed = stage(wanted, "wanted")
    out = stage(whole.join(_sized(needed), ["r1", "r2"]).select("node", F.expr("element_at(split(text, '\\n'), pos + 1)").alias("line")), "line_texts")
    release(needed)
    return out


def _links(pairs: DataFrame, sets: DataFrame, similarity: float, texts: DataFrame | None = None) -> DataFrame:
    """Pairs whose shingle sets reach ``similarity``; ``sets(node, width)`` and ``texts(node, line)``, or one table for both.

    Sets are compared where their sizes, and odd sketches if there, allow it.
    """
    texts = sets if texts is None else texts
    bits = _bits(sets)
    near = _with(pairs, sets, w="width", **{c: c for c in bits}).where(F.expr(_may_reach("w_a", "w_b", similarity)))
    near = stage((near.where(F.expr(_may_differ(bits, "_a", "_b", similarity))) if bits else near).select("a", "b"), "near")
    same = _jaccard(f"array_distinct({_shingles('line_a')})", f"array_distinct({_shingles('line_b')})", similarity)
    found = stage(_with(near, texts, line="line").where(F.expr(same)).select("a", "b"), "links")
    release(near)
    return found


def _class_of(posted: DataFrame, links: DataFrame) -> DataFrame:
    comp = components(links).select("node", F.col("component").alias("c"))
    return posted.join(comp, "node", "left").select("key", "node", F.coalesce("c", "node").alias("comp"))


def _open(classed: DataFrame) -> DataFrame:
    """Entries of bands that still hold several components, with the band's size."""
    several = classed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("key", "size")
    return classed.join(several, "key")


def _prefixes(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, node, comp, width): every open line under the shingles of its prefix.

    Shingles are ordered from rare to frequent among the open lines. Of two sets that reach the
    similarity, the first width - ceil(similarity * width) + 1 of either share one, so no link is
    lost; lines that have only frequent shingles in common do not meet.
    """
    open_ = sets.join(left.select("node", "comp").distinct(), "node")
    x = open_.select("node", F.expr("cast(line as binary)").alias("b"))
    x = x.select("node", "b", F.explode(F.expr(f"sequence(1, greatest(octet_length(b) - {SHINGLE - 1}, 1))")).alias("i"))
    x = x.select("node", F.expr(f"xxhash64(substring(b, i, {SHINGLE}))").alias("key"))
    # a shingle that stands once comes first and meets nothing: it only takes its place in the prefix
    often = x.groupBy("key").agg(F.count("*").alias("f")).where("f > 1")
    ranked = x.join(often, "key").groupBy("node").agg(F.sort_array(F.collect_set(F.struct("f", "key"))).alias("t"))
    rest = f"size(t) - cast(ceil({similarity}D * width - 1e-9) as int) + 1"
    ranked = ranked.join(open_.select("node", "comp", "width"), "node").where(f"{rest} > 0")
    return ranked.select("node", "comp", "width", F.explode(F.expr(f"slice(t, 1, {rest})")).alias("p")).select("p.key", "node", "comp", "width")


def _apart(left: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of a key's entries from different components whose sizes, and odd sketches if there, allow the similarity.

    Such sizes lie in one length class or in classes side by side; others do not meet. An entry
    stands in the cell of its class and in the next one, a pair counts in the cell of the larger.
    """
    step = math.log(1 / similarity) + 1e-6
    bits = _bits(left)
    x = left.select("key", "node", "comp", "width", F.floor(F.log("width") / F.lit(step)).cast("int").alias("class"), *bits)
    x = x.select("*", F.explode(F.expr("sequence(class, class + 1)")).alias("cell"))
    a, b = (x.select("key", "cell", *(F.col(c).alias(f"{n}_{end}") for c, n in [("node", "n"), ("comp", "c"), ("width", "w"), ("class", "k"), *zip(bits, bits)])) for end in "ab")
    allowed = ["n_a < n_b", "c_a <> c_b", "cell = greatest(k_a, k_b)", _may_reach("w_a", "w_b", similarity), *([_may_differ(bits, "_a", "_b", similarity)] if bits else [])]
    return a.join(b, ["key", "cell"]).where(" and ".join(allowed)).select(F.col("n_a").alias("a"), F.col("n_b").alias("b")).distinct()


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(r1, r2, gone): digest of a document row and the positions of the lines that go."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = rows.select("doc_id", *_digest(F.col("doc_id"), F.col("text")), F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("trim(line) <> ''")
    rows = rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), F.col("line"))})
    lines = stage(rows.select("doc_id", "r1", "r2", "pos", "h1", "h2"), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "r1", "r2", "pos")
    whole = docs.select(*_digest(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.col("text").cast("string").alias("text"))
    sketches = _sketches(rows, ["h1", "h2"])
    counted = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    # the smaller the node, the more repeated the line
    node = F.expr("shiftleft(62L - cast(floor(log2(n)) as bigint), 56) + monotonically_increasing_id()")
    distinct = stage(counted.join(sketches, ["h1", "h2"], "left").select("h1", "h2", "n", node.alias("node"), "first", "keys", _weak().alias("weak")), "distinct_lines")
    again = _texts(distinct.where("weak").select("node"), distinct, whole)
    whole_keys = stage(_sketches(again, ["node"], cut=False).select("node", "keys"), "whole_keys")
    entries = distinct.where("not weak").select("node", "keys").union(whole_keys).select("node", F.explode("keys").alias("key"))

    bands = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("centre")).where("size > 1").select("key", "size", "centre")
    posted = stage(entries.join(bands, "key"), "bands")
    texts = _texts(posted.select("node").distinct(), distinct, whole)
    sizes = stage(_odd_sketches(texts), "sizes")
    release(again, whole_keys)

    def found(pairs: DataFrame) -> DataFrame:
        return _links(pairs, sizes, similarity, texts)

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    tested = stage(ordered(posted.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))), "tested")
    made = [tested]  # helper tables, removed when the components are known
    links = found(tested)
    # a band of two has been compared
    left = stage(_open(_class_of(posted.where("size > 2").select("key", "node"), links)), "open")
    for star in range(1, _STARS):
        crowded = left.where(F.col("size") > _CROWDED)
        if crowded.isEmpty():
            break
        hashed = F.struct(F.xxhash64(F.lit(star), F.col("node")).alias("h"), F.col("node").alias("v"), F.col("comp").alias("c"))
        centre = crowded.groupBy("key").agg(F.min(hashed).alias("m")).select("key", F.col("m.v").alias("b"), F.col("m.c").alias("cb"))
        pairs = stage(ordered(crowded.join(centre, "key").where("comp <> cb").select(F.col("node").alias("a"), "b")).join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(pairs)
        links = links.union(found(pairs))
        made += [pairs, left]
        left = stage(_open(_class_of(left.select("key", "node"), links)), "open")
    if not left.isEmpty():
        links = links.union(found(_apart(left.join(sizes, "node"), similarity).join(tested, ["a", "b"], "left_anti")))

    comp = stage(components(links), "components")
    release(posted, left, sizes, texts, *made)
    classed = distinct.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = classed.groupBy("component").agg(F.min("first").alias("kept"), F.sum("n").alias("total")).where("total > 1")
    hit = classed.join(kept, "component").select("h1", "h2", "kept")
    gone = lines.select("h1", "h2", "r1", "r2", "pos", place.alias("at")).join(hit, ["h1", "h2"]).where("at <> kept")
    found = stage(gone.groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone")), "gone")
    release(lines, distinct, comp)
    return found


def _digest(doc_id, text) -> tuple:
    return F.xxhash64(doc_id, text).alias("r1"), F.xxhash64(F.lit(7), text).alias("r2")


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, counts: bool = False) -> DataFrame:
    """``docs`` with the lines that go cut out of ``text``; with ``counts`` also the columns n_lines and n_removed."""
    gone = _sized(removed_lines(docs, similarity))
    tag = uuid.uuid4().hex  # helper names that no column of docs can have
    r1, r2, g = f"r1_{tag}", f"r2_{tag}", f"gone_{tag}"
    a, b = _digest(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    both = docs.withColumns({r1: a, r2: b}).join(gone.toDF(r1, r2, g), [r1, r2], "left")
    text = F.expr(f"CASE WHEN {g} IS NULL THEN cast(text as string) ELSE array_join(filter(split(text, '\\n'), (x, i) -> NOT array_contains({g}, i)), '\\n') END")
    extra = [F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(F.col(g)), F.lit(0)).cast("long").alias("n_removed")] if counts else []
    return both.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns), *extra)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts=True).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op2_line_dedup": op2_line_dedup}

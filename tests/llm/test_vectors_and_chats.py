"""Vector search and quotation linking against brute force."""

import math

import numpy as np
import pandas as pd
import pytest

from sparkwright.llm import pstable_mips, quotes


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")


def test_search_recall_and_scores(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(700, 16)) * g.uniform(0.2, 2, size=(700, 1))
    x[300:360] = x[0]  # a group of equal vectors
    x = x.astype(np.float32)
    df = _vectors(spark, [(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)])
    got = pstable_mips.search(df, df.where("vec_id % 20 = 0")).collect()
    hit = total = 0
    d = x.astype(float)
    for q in range(0, 700, 20):
        s = (d[q] * d).sum(-1)
        s[q] = -np.inf
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(r["score"] == s[r["vec_id"]] for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        best = np.lexsort((np.arange(700), -s))[:20]
        hit, total = hit + len(set(best.tolist()) & {r["vec_id"] for r in mine}), total + 20
    assert hit / total >= 0.9


def test_ties_at_the_cut_go_to_the_smaller_ids():
    low = np.random.default_rng(5).permutation(90)
    rows = [(False, [0.0, float(i + 1)], int(v), 0, int(v)) for i, v in enumerate(low)] + [(True, [1.0, 0.0], 500, 0, 500)]
    got = pstable_mips._block(20)(pd.DataFrame(rows, columns=["query", "v", "k1", "k2", "low"]))
    assert got["low"].tolist() == list(range(20)) and (got["score"] == 0).all()


def test_vectors_that_take_no_part(spark):
    ok = [(i, [math.cos(i), math.sin(i), 0.5], 0, 0.0) for i in range(0, 120, 5)]
    odd = [(200, None, 0, 0.0), (220, [0.0, 0.0, 0.0], 0, 0.0), (240, [float("nan"), 1.0, 1.0], 0, 0.0), (260, [float("inf"), 1.0, 1.0], 0, 0.0),
           (280, [1.0, None, 2.0], 0, 0.0), (None, [1.0, 1.0, 1.0], 0, 0.0), (300, [1.0], 0, 0.0), (320, [], 0, 0.0), ok[3], ok[4]]
    df = _vectors(spark, ok + odd)
    got = pstable_mips.search(df, df.where("vec_id % 20 = 0")).collect()
    ids = {r[0] for r in ok}
    assert {r["query_id"] for r in got} == {i for i in ids if i % 20 == 0}
    assert {r["vec_id"] for r in got} <= ids and all(r["vec_id"] != r["query_id"] for r in got)
    empty = _vectors(spark, [])
    assert pstable_mips.search(empty, empty).count() == 0


def test_every_length_is_searched_by_itself(spark):
    g = np.random.default_rng(3)
    rows = [(i, g.normal(size=3 if i % 3 else 5).tolist(), 0, 0.0) for i in range(200)]
    x = {i: np.array(v, np.float32).astype(float) for i, v, _, _ in rows}
    df = _vectors(spark, rows)
    got = pstable_mips.search(df, df.where("vec_id % 20 = 0")).collect()
    hit = 0
    for q in range(0, 200, 20):
        best = sorted((-(x[q] * x[i]).sum(), i) for i in x if i != q and len(x[i]) == len(x[q]))[:20]
        mine = [r["vec_id"] for r in got if r["query_id"] == q]
        assert all(len(x[i]) == len(x[q]) for i in mine)
        hit += len({i for _, i in best} & set(mine))
    assert hit >= 180


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_visits_widen_until_the_target_is_met(spread):
    g = np.random.default_rng(4)
    x = g.normal(size=(400, 8)) * np.exp(g.normal(size=(400, 1)) * spread)
    norm = np.linalg.norm(x, axis=1).max()
    hashes, visits = pstable_mips.choose_visits(x, norm, 20, first=0)  # one cell a table misses most neighbours
    assert hashes.reach > 0 and visits <= len(hashes.steps)
    score = x[:100] @ x.T
    score[np.arange(100), np.arange(100)] = -np.inf
    true = np.argsort(-score, axis=1)[:, :20]
    seen = np.zeros(true.shape, bool)
    for t in range(pstable_mips.TABLES):
        seen |= (hashes.cells(x, t)[true][:, :, None] == hashes.probes(x[:100], t, visits)[:, None, :]).any(2)
    assert seen.mean() >= pstable_mips.TARGET


def _chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")


def test_quotes_link_to_their_source(spark):
    df = _chat(spark, [
        (1, 0, "a", "Hello there\nSecond  line", 0), (1, 1, "b", "> hello   THERE\nMy reply\nmore", 0),
        (1, 2, "c", ">> Hello there\n> my reply\n> more\nanswer", 0), (1, 3, "d", "> nobody said this\n\n", 0),
        (1, 4, "e", "> answer\n> second line\n> hello there\nlate", 0), (2, 1, "b", "> answer", 0)])
    got = {(r["conv_id"], r["turn"]): r for r in quotes.messages(df).collect()}
    assert got[1, 2]["text"] == "answer" and got[1, 2]["n_quoted"] == 3
    assert {k: v["parent_turn"] for k, v in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): None, (1, 4): 0, (2, 1): None}
    assert got[1, 2]["depth"] == 2 and got[1, 2]["root_turn"] == 0
    order = [r["turn"] for r in sorted((r for r in got.values() if r["conv_id"] == 1), key=lambda r: r["reply_path"])]
    assert order == [0, 1, 2, 4, 3]
    found = {(r["turn"], r["level"], r["first_line"]): (r["n_lines"], r["source_turn"]) for r in quotes.passages(df).where("conv_id = 1").collect()}
    assert found[2, 2, 0] == (1, 0) and found[2, 1, 1] == (2, 1) and found[3, 1, 0] == (1, None)


@pytest.mark.parametrize("common", [64, 1])
def test_quotes_link_to_the_message_with_the_whole_passage(spark, monkeypatch, common):
    monkeypatch.setattr(quotes, "_COMMON", common, raising=False)
    sign = "Best\nJo Doe\nSome Street 5\nTown"
    quote = lambda text: "\n".join("> " + x for x in text.split("\n"))
    texts = ["start", "first\n" + sign, "hello\nthanks", "thanks", "and\nso on", "one\ntwo\nthree\n" + sign, sign, quote("one\ntwo\nthree\n" + sign) + "\nanswer",
             quote(sign), quote("thanks"), quote("so on\nthanks"), quote("best\nhello\nthanks") + "\n>> and\n>> so on", quote("later"), "later"]
    df = _chat(spark, [(c, t, "a", x, 0) for c in (1, 2) for t, x in enumerate(texts)])
    got = {(r["conv_id"], r["turn"]): r["parent_turn"] for r in quotes.messages(df).collect()}
    assert all({t: got[c, t] for t in range(7, 13)} == {7: 5, 8: 1, 9: 2, 10: 4, 11: 2, 12: None} for c in (1, 2))
    found = {(r["turn"], r["level"], r["first_line"]): (r["n_lines"], r["source_turn"], r["n_linked"]) for r in quotes.passages(df).where("conv_id = 2").collect()}
    assert found[7, 1, 0] == (7, 5, 7) and found[11, 2, 3] == (2, 4, 2) and found[12, 1, 0] == (1, None, None)
    assert "op5_quotes_passages" in quotes.QUERIES


def test_sources_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quotes, "_COMMON", 3, raising=False)
    g = np.random.default_rng(9)
    own = [[f"line {k}" for k in sorted(set((g.zipf(1.4, g.integers(1, 7)) % 25).tolist()))] for _ in range(80)]
    cited = [[f"line {k}" for k in (g.zipf(1.4, g.integers(1, 7)) % 25).tolist()] for _ in range(80)]
    df = _chat(spark, [(3, t, "a", "\n".join(["> " + x for x in cited[t]] + own[t]), 0) for t in range(80)])
    got = {r["turn"]: r["parent_turn"] for r in quotes.replies(df).collect()}
    for t in range(80):
        best = {}  # lines held -> earliest message
        for s in range(t):
            held = tuple(sorted(x for x in cited[t] if x in own[s]))
            if held:
                best.setdefault(held, s)
        assert got.get(t) == max(((len(h), s) for h, s in best.items()), default=(0, None))[1]


def test_long_reply_chains(spark):
    rows = [(7, t, "x", (f"> line {t - 1}\n" if t else "") + f"line {t}", 0) for t in range(40)]
    got = {r["turn"]: r for r in quotes.messages(_chat(spark, rows)).collect()}
    assert all(got[t]["depth"] == t and got[t]["root_turn"] == 0 for t in range(40))
    assert sorted(range(40), key=lambda t: got[t]["reply_path"]) == list(range(40))


def test_awkward_chats(spark):
    rows = [(1, 0, None, None, 0), (1, 0, "a", "", 0), (None, 1, "a", "> x", 0), (1, None, "a", "> x\nx", 0), (1, -2, "a", "x", 0),
            (1, 5, "a", "> x", 0), (1, 5, "a", "> x", 0)]
    got = quotes.messages(_chat(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [r["parent_turn"] for r in got if r["turn"] == 5] == [-2, -2]
    assert quotes.messages(_chat(spark, [])).count() == 0 and quotes.passages(_chat(spark, [])).count() == 0


def test_quoting_messages_equal_sql(spark, tmp_path):
    """Conversations that quote themselves, with copies, shared lines, nulls and blanks, against the SQL."""
    import duckdb
    g = np.random.default_rng(6)
    say = ["Thanks!", "see you  THEN", "", "a plan", "> quoted before", "regards", "one more line"]
    rows = [(c, t, "u", None if g.random() < .05 else "\n".join(g.choice(say, g.integers(1, 5))), 0) for c in range(12) for t in range(9)]
    rows += [(None, 1, "u", "a plan", 0), (3, None, "u", "> a plan", 0)]
    path = str(tmp_path / "c.parquet")
    _chat(spark, rows).write.parquet(path)
    chats = quotes.quoting(spark.read.parquet(path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/*.parquet'")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    planted = [tuple(r) for r in quotes.messages(chats).selectExpr("conv_id", "turn", "n_quoted", "parent_turn", "root_turn", "depth", "reply_path", "md5(text)").collect()]
    sql = con.execute(f"select conv_id, turn, n_quoted, parent_turn, root_turn, depth, reply_path, text_md5 from ({quotes.ORACLE['op5_quotes_planted']}) where turn is not null").fetchall()
    assert sorted((r for r in planted if r[1] is not None), key=key) == sorted(sql, key=key)
    assert sum(r[3] is not None for r in planted) > 50
    chats.write.parquet(str(tmp_path / "p.parquet"))
    con.execute(f"create or replace view conversations as select * from '{tmp_path}/p.parquet/*.parquet'")
    spans = [tuple(r) for r in quotes.passages(chats).select("conv_id", "turn", "level", "first_line", "n_lines", "source_turn", "n_linked").collect()]
    sql = con.execute(f"select conv_id, turn, level, first_line, n_lines, source_turn, n_linked from ({quotes.ORACLE['op5_quotes_passages']})").fetchall()
    assert sorted(spans, key=key) == sorted(sql, key=key) and len(spans) > 100

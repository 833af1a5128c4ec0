"""Chat formatting: links quoted passages to the messages they come from.

A line's quote level is the number of ``>`` marks in front (spaces may stand between). A
message's own lines have level 0. Quoted lines are normalised (lower case, inner white space
to one space, ends trimmed) and hashed; so are all own lines. The source of a passage
(adjacent lines of one level) is the earlier message of the same conversation that has most
of its lines as its own, whoever else has them too. Of messages that have the same lines of
it the earliest counts; other ties go to the later one. A message replies to the source of
its level-1 lines, found in the same way. Reply order puts every message after the one it
replies to, replies by turn.

``messages`` gives each message without quotes and its place: parent_turn, root_turn,
depth and reply_path (turns from the root on, padded, so that sorting by it is reply order).
``passages`` gives every quoted passage with its level and source. All steps are joins and
aggregates on (conversation, line hash) or (conversation, turn); no conversation is ever
collected. Messages meet a passage one by one only through lines that few messages have;
what is made of common lines alone (greetings, signatures) is looked up once for all
passages with the same common lines.

Defined cases: null text has no lines and gives an empty own text; blank lines link
nothing; null conversation ids or turns link nothing and are roots (reply_path null where
the turn is null); messages that share a turn share parent and path; negative turns sort
before others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import read, stage

_MARK = r"^(?:[ \t]*>)+"
_COMMON = 64  # a line that more messages of the conversation have as their own is common


def _lines(chats: DataFrame) -> DataFrame:
    """conv_id, turn, message row, line number, quote level, line without marks, hash of the normalised line."""
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("text").cast("string").alias("text"))
    mark = F.regexp_extract("raw", _MARK, 0)
    cut = rows.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("n", "raw")).withColumn("mark", mark)
    line = F.expr("substring(raw, length(mark) + 1)")
    cut = cut.select("conv_id", "turn", "n", F.length(F.regexp_replace("mark", r"[ \t]", "")).alias("level"), line.alias("line"))
    return cut.withColumn("norm", normalise(F.col("line"))).withColumn("h", F.md5("norm"))


def normalise(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[ \t\r\f\x0b]+", " "))


def own_text() -> Column:
    """Text without quoted lines, blank ends cut off."""
    kept = F.expr(r"array_join(filter(split(coalesce(cast(text as string), ''), '\n'), x -> NOT x RLIKE '^[ \\t]*>'), '\n')")
    return F.regexp_replace(kept, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def _quoted_and_own(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quoted lines, and the messages (source_turn) that have one of them as their own line."""
    lines = _lines(chats).where("conv_id is not null and turn is not null and norm <> ''")
    quoted = stage(lines.where("level > 0").select("conv_id", "turn", "n", "level", "h"), "quoted")
    own = lines.where("level = 0").select("conv_id", "h", F.col("turn").alias("source_turn"))
    return quoted, stage(own.join(quoted.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi").distinct(), "own")


def _sources(quoted: DataFrame, own: DataFrame, by: list[str]) -> DataFrame:
    """The source of each group of quoted lines (source_turn, n_linked); ``by`` starts with conv_id and turn."""
    held = F.md5(F.concat_ws(",", F.sort_array(F.collect_list("h")))).alias("held")
    votes = F.sum("k").alias("votes")
    wanted = quoted.groupBy(*by, "h").agg(F.count("*").alias("k"))
    wanted = stage(wanted.join(own.groupBy("conv_id", "h").agg((F.count("*") > _COMMON).alias("common")), ["conv_id", "h"]), "wanted")

    # messages with an uncommon line of the group: all lines of the group that they have
    met = wanted.where("not common").join(own, ["conv_id", "h"]).where("source_turn < turn").select(*by, "source_turn").distinct()
    full = met.join(wanted.select(*by, "h", "k"), by).join(own, ["conv_id", "h", "source_turn"], "left_semi")
    full = full.groupBy(*by, "source_turn").agg(votes, held)

    # messages with common lines only: once for all groups with the same ones
    usual = wanted.where("common").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("h", "k"))).alias("lines"))
    usual = stage(usual.withColumn("kind", F.md5(F.to_json("lines"))), "usual")
    kinds = usual.select("conv_id", "kind", "lines").distinct().select("conv_id", "kind", F.inline("lines"))
    kinds = kinds.join(own, ["conv_id", "h"]).groupBy("conv_id", "kind", "source_turn").agg(votes, held)
    kinds = kinds.groupBy("conv_id", "kind", "held", "votes").agg(F.min("source_turn").alias("source_turn"))
    part = usual.select(*by, "kind").join(kinds, ["conv_id", "kind"]).where("source_turn < turn")

    every = full.unionByName(part.select(*by, "source_turn", "votes", "held"))
    first = every.groupBy(*by, "held", "votes").agg(F.min("source_turn").alias("source_turn"))
    best = F.max(F.struct("votes", "source_turn")).alias("m")
    return first.groupBy(*by).agg(best).select(*by, F.col("m.source_turn").alias("source_turn"), F.col("m.votes").alias("n_linked"))


def passages(chats: DataFrame) -> DataFrame:
    """conv_id, turn, level, first_line, n_lines, source_turn, n_linked per quoted passage."""
    lines, own = _quoted_and_own(chats)
    # adjacent lines of one level: line number minus the count of such lines before it is constant
    every = lines.select("conv_id", "turn", "level", "n").distinct()
    starts = every.join(every.select("conv_id", "turn", "level", (F.col("n") + 1).alias("n")), ["conv_id", "turn", "level", "n"], "left_anti")
    starts = starts.groupBy("conv_id", "turn", "level").agg(F.sort_array(F.collect_list("n")).alias("starts"))  # of one message
    first = F.expr("array_max(filter(starts, s -> s <= n))").alias("first_line")
    placed = lines.join(starts, ["conv_id", "turn", "level"]).select("conv_id", "turn", "level", first, "n", "h")
    by = ["conv_id", "turn", "level", "first_line"]
    return placed.groupBy(*by).agg(F.countDistinct("n").alias("n_lines")).join(_sources(placed, own, by), by, "left")


def replies(chats: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn of messages with a linked level-1 quote."""
    quoted, own = _quoted_and_own(chats)
    return _sources(quoted.where("level = 1"), own, ["conv_id", "turn"]).select("conv_id", "turn", F.col("source_turn").alias("parent_turn"))


def _path(turn: Column) -> Column:
    return F.when(turn < 0, F.format_string("-%019d", turn + F.lit(2 ** 62))).otherwise(F.format_string("0%019d", turn))


def messages(chats: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quoted, parent_turn, root_turn, depth, reply_path."""
    linked = stage(replies(chats), "replies")
    # upward pointers, doubled each round; the path so far is carried along
    up = stage(linked.select("conv_id", "turn", F.col("parent_turn").alias("top"), F.lit(1).cast("long").alias("depth"),
                             _path(F.col("turn")).alias("path")), "up")
    while True:
        higher = up.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("top2"), F.col("depth").alias("depth2"), F.col("path").alias("path2"))
        if up.join(higher, ["conv_id", "top"], "left_semi").isEmpty():
            break
        both = up.join(higher, ["conv_id", "top"], "left")
        up = stage(both.select("conv_id", "turn", F.coalesce("top2", "top").alias("top"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
                               F.concat_ws("/", "path2", "path").alias("path")), "up")
    place = up.join(linked, ["conv_id", "turn"]).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "parent_turn", "top", "depth", "path")
    n_quoted = F.expr(r"size(filter(split(coalesce(cast(text as string), ''), '\n'), x -> x RLIKE '^[ \\t]*>'))").cast("long")
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                        own_text().alias("text"), n_quoted.alias("n_quoted"))
    out = rows.join(place, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    root = F.coalesce("top", "turn")
    return out.select("conv_id", "turn", "role", "text", "n_quoted", "parent_turn", root.alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
                      F.when(F.col("top").isNull(), _path(F.col("turn"))).otherwise(F.concat_ws("/", _path(F.col("top")), "path")).alias("reply_path"))


def op5_quotes(spark, sf_dir: str) -> DataFrame:
    m = messages(read(spark, sf_dir, "conversations"))
    return m.select("conv_id", "turn", "role", "n_quoted", "parent_turn", "root_turn", "depth", "reply_path", F.md5("text").alias("text_md5"))


def op5_quotes_passages(spark, sf_dir: str) -> DataFrame:
    return passages(read(spark, sf_dir, "conversations"))


def quoting(chats: DataFrame) -> DataFrame:
    """``chats`` with quotes of the conversation's own earlier messages in front: level 1 of one, in every third turn level 2 of another."""
    rows = chats.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    said = chats.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("text").cast("string").alias("said")).where("text is not null")
    for marks, back, where in ((">> ", F.lit(3), F.col("turn") % 3 == 0), ("> ", 1 + F.col("turn") % 2, F.col("turn") > 0)):
        quote = F.concat(F.lit(marks), F.replace("said", F.lit("\n"), F.lit("\n" + marks)))
        met = rows.join(said, where & (F.col("conv_id") == F.col("c")) & (F.col("t") == F.col("turn") - back), "left")
        rows = met.select("conv_id", "turn", "role", "text", *(c for c in rows.columns if c[0] == "q"), quote.alias(f"q{len(marks)}"))
    return rows.select("conv_id", "turn", "role", F.concat_ws("\n", "q3", "q2", "text").alias("text"))


def op5_quotes_planted(spark, sf_dir: str) -> DataFrame:
    """Messages and their places, in conversations that quote themselves."""
    m = messages(quoting(read(spark, sf_dir, "conversations")))
    return m.select("conv_id", "turn", "role", "n_quoted", "parent_turn", "root_turn", "depth", "reply_path", F.md5("text").alias("text_md5"))


QUERIES = {"op5_quotes": op5_quotes, "op5_quotes_passages": op5_quotes_passages, "op5_quotes_planted": op5_quotes_planted}
_NORM = r"""
raw AS (
  SELECT c.conv_id, c.turn, u.n, u.line AS raw
  FROM conversations c, UNNEST(string_split(c.text, chr(10))) WITH ORDINALITY AS u(line, n)),
lines AS (
  SELECT conv_id, turn, n, regexp_extract(raw, '^(?:[ \t]*>)+') AS mark, raw FROM raw),
norm AS (
  SELECT conv_id, turn, n, length(regexp_replace(mark, '[ \t]', '', 'g')) AS lev,
    trim(regexp_replace(lower(substr(raw, length(mark) + 1)), '[ \t\r\f\v]+', ' ', 'g')) AS line FROM lines),
own AS (SELECT DISTINCT conv_id, line, turn AS src FROM norm WHERE lev = 0 AND line <> '')"""
_MESSAGES = "WITH RECURSIVE" + _NORM + r""",
wanted AS (SELECT conv_id, turn, line, count(*) AS k FROM norm WHERE lev = 1 AND line <> '' GROUP BY ALL),
votes AS (
  SELECT w.conv_id, w.turn, o.src, sum(w.k) AS v, string_agg(md5(w.line), ',' ORDER BY md5(w.line)) AS held
  FROM wanted w JOIN own o USING (conv_id, line) WHERE o.src < w.turn GROUP BY ALL),
firsts AS (SELECT conv_id, turn, v, held, min(src) AS src FROM votes GROUP BY ALL),
parent AS (
  SELECT conv_id, turn, src AS parent_turn FROM firsts
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY v DESC, src DESC) = 1),
walk AS (
  SELECT conv_id, turn, parent_turn AS top, 1 AS depth, format('0{:019d}', turn) AS path FROM parent
  UNION ALL
  SELECT w.conv_id, w.turn, p.parent_turn, w.depth + 1, format('0{:019d}', p.turn) || '/' || w.path
  FROM walk w JOIN parent p ON p.conv_id = w.conv_id AND p.turn = w.top),
deep AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY depth DESC) = 1)
SELECT c.conv_id, c.turn, c.role,
  CAST(len(list_filter(string_split(coalesce(c.text, ''), chr(10)), lambda x: regexp_matches(x, '^[ \t]*>'))) AS BIGINT) AS n_quoted,
  p.parent_turn, coalesce(d.top, c.turn) AS root_turn, CAST(coalesce(d.depth, 0) AS BIGINT) AS depth,
  CASE WHEN d.top IS NULL THEN format('0{:019d}', c.turn) ELSE format('0{:019d}', d.top) || '/' || d.path END AS reply_path,
  md5(regexp_replace(array_to_string(list_filter(string_split(coalesce(c.text, ''), chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10)),
    '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) AS text_md5
FROM conversations c LEFT JOIN parent p USING (conv_id, turn) LEFT JOIN deep d USING (conv_id, turn)"""
_PASSAGES = "WITH" + _NORM + r""",
placed AS (
  SELECT DISTINCT conv_id, turn, lev, n FROM norm WHERE lev > 0 AND line <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
firsts AS (
  SELECT *, min(n) OVER (PARTITION BY conv_id, turn, lev, island) AS first_line
  FROM (SELECT *, n - row_number() OVER (PARTITION BY conv_id, turn, lev ORDER BY n) AS island FROM placed)),
sized AS (SELECT conv_id, turn, lev, first_line, count(*) AS n_lines FROM firsts GROUP BY ALL),
wanted AS (
  SELECT f.conv_id, f.turn, f.lev, f.first_line, q.line, count(*) AS k
  FROM firsts f JOIN norm q USING (conv_id, turn, lev, n) WHERE q.line <> '' GROUP BY ALL),
votes AS (
  SELECT w.conv_id, w.turn, w.lev, w.first_line, o.src, sum(w.k) AS v, string_agg(md5(w.line), ',' ORDER BY md5(w.line)) AS held
  FROM wanted w JOIN own o USING (conv_id, line) WHERE o.src < w.turn GROUP BY ALL),
earliest AS (SELECT conv_id, turn, lev, first_line, v, held, min(src) AS src FROM votes GROUP BY ALL),
best AS (SELECT * FROM earliest QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lev, first_line ORDER BY v DESC, src DESC) = 1)
SELECT s.conv_id, s.turn, CAST(s.lev AS INTEGER) AS level, CAST(s.first_line - 1 AS INTEGER) AS first_line, s.n_lines,
  b.src AS source_turn, CAST(b.v AS BIGINT) AS n_linked
FROM sized s LEFT JOIN best b USING (conv_id, turn, lev, first_line)"""
# conversations that quote themselves
_PLANTED = """planted AS (
  SELECT c.conv_id, c.turn, c.role, concat_ws(chr(10), '>> ' || replace(b.text, chr(10), chr(10) || '>> '),
    '> ' || replace(a.text, chr(10), chr(10) || '> '), c.text) AS text
  FROM conversations c
  LEFT JOIN conversations a ON a.conv_id = c.conv_id AND c.turn > 0 AND a.turn = c.turn - 1 - c.turn % 2 AND a.text IS NOT NULL
  LEFT JOIN conversations b ON b.conv_id = c.conv_id AND c.turn % 3 = 0 AND b.turn = c.turn - 3 AND b.text IS NOT NULL),"""
ORACLE = {"op5_quotes": _MESSAGES, "op5_quotes_passages": _PASSAGES,
          "op5_quotes_planted": _MESSAGES.replace("conversations c", "planted c").replace("WITH RECURSIVE", "WITH RECURSIVE " + _PLANTED, 1)}

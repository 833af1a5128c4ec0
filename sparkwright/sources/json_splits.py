"""Records of a JSON array from byte ranges, so that one large file is read by many tasks.

The text scan is told to cut at ``}``: every row is the text up to a closing brace, whatever
line breaks there are. Two facts about everything before a range decide what it holds: whether
it begins inside a string, and at which depth. Both come from a first pass that reads each
range under both assumptions about strings and leaves one row: the state it ends in, and by how
much the depth changes, for either start. States compose like the quotes of CSV ranges; depths
add up. The second pass cuts out the objects at depth one. An object that a border
cuts leaves its pieces, which are put together by the range in which it begins.

What is no array of objects raises: other values among the objects, brackets that do not
match, text after the array, strings that never end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.sources.csv_splits import BEGINNING, REST, WHOLE, _parts
from sparkwright.sources.sinks import stage_table

_RANGES = "file string, at long, size long, from_outside boolean, from_inside boolean, up_outside long, up_inside long, bytes long"
_RECORDS = "key long, at long, kind int, record binary"
_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_MARK = b"\xef\xbb\xbf"


def scan(piece: bytes) -> tuple[bool, int, int]:
    """(whether the quotes in the text swap the state, opened less closed brackets if it begins outside, and if inside a string).

    The closing brace after the text is not counted.
    """
    if b"\\" in piece:
        piece = _ESCAPE.sub(b"", piece)
    parts = piece.split(b'"')
    even = b"".join(parts[::2])
    odd = b"".join(parts[1::2])
    level = lambda t: t.count(b"{") + t.count(b"[") - t.count(b"]")
    return len(parts) % 2 == 0, level(even), level(odd)


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("piece"))


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[list] = []
    for new, part in _parts(batches, ["file", "at"]):
        if new:
            rows.append([part.column("file")[0].as_py(), part.column("at")[0].as_py(), part.column("size")[0].as_py(), False, True, 0, 0, 0])
        row = rows[-1]
        for piece in part.column("piece").to_pylist():
            swaps, even, odd = scan(piece)
            for state, up in ((3, 5), (4, 6)):
                row[up] += odd if row[state] else even
                row[state] ^= swaps
                row[up] -= not row[state]  # the brace
            row[7] += len(piece) + 1
    if rows:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in _RANGES.split(", "))])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def ranges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per range with the state and depth in which it begins (staged); raises if a file is no closed array."""
    passed = stage_table(_pieces(spark, path).mapInArrow(_states, _RANGES), "json_ranges")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # quotes either swap the state of a range or keep it
    inside = F.coalesce(F.sum(F.col("from_outside").cast("int")).over(before), F.lit(0)) % 2 == 1
    started = passed.withColumn("inside", inside).withColumn("up", F.when(F.col("inside"), F.col("up_inside")).otherwise(F.col("up_outside")))
    known = stage_table(started.withColumn("depth", F.coalesce(F.sum("up").over(before), F.lit(0))), "json_states")
    # the text after the last brace has no brace of its own, which was counted all the same
    files = known.groupBy("file").agg((F.sum("up") + 1).alias("end"), (F.sum("bytes") - F.max("size")).alias("over"),
                                      (F.sum(F.col("from_outside").cast("int")) % 2).alias("open"))
    if not files.where("end <> 0 or over <> 1 or open <> 0").isEmpty():
        raise ValueError("The file is not valid JSON.")
    return known.select("file", "at", "inside", "depth")


def _emit(pieces_only: bool):
    """Pass 2: the objects of ranges whose first state is known (``pieces_only``: what the borders cut, instead)."""
    names = [c.split()[0] for c in _RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        inside, depth, rest, place = False, 0, False, None

        def batch(kind: int, records: list[bytes]) -> pa.RecordBatch:
            n = len(records)
            return pa.RecordBatch.from_arrays([pa.array([place[0]] * n, pa.int64()), pa.array([place[1]] * n, pa.int64()),
                                               pa.array([kind] * n, pa.int32()), pa.array(records, pa.binary())], names)

        def cut() -> Iterator[pa.RecordBatch]:
            if pieces_only and held:
                yield batch(REST if rest else BEGINNING, [b"}".join(held)])

        for new, part in _parts(batches, ["key", "at"]):
            if new:
                if place:
                    yield from cut()
                if part.column("inside")[0].as_py() is None:
                    raise ValueError("The ranges of the files have changed while they were read.")
                place = (part.column("key")[0].as_py(), part.column("at")[0].as_py())
                inside, depth = part.column("inside")[0].as_py(), part.column("depth")[0].as_py()
                held, rest = [], depth > 1
            done = []
            for piece in part.column("piece").to_pylist():
                if not held and not rest:  # between two objects
                    at = piece.find(b"{")
                    head = (piece if at < 0 else piece[:at]).removeprefix(_MARK).strip(b" \t\r\n")
                    if at < 0 and (head == b"]" and depth == 1 or head == b"[]" and depth == 0 or not head and depth < 1):
                        depth -= 1 + (depth == 1)
                        continue
                    if at < 0 or head != (b"[" if depth == 0 else b","):
                        raise ValueError("The file is not valid JSON: it holds more than one array of objects.")
                    depth = 1
                    piece = piece[at:]
                swaps, even, odd = scan(piece)
                depth += odd if inside else even
                inside ^= swaps
                depth -= not inside
                held.append(piece)
                if depth == 1 and not inside:
                    if rest:
                        yield from cut()
                    else:
                        done.append(b"}".join(held) + b"}")
                    held, rest = [], False
            if done and not pieces_only:
                yield batch(WHOLE, done)
        if place:
            yield from cut()
    return run


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(record) the text of every object in the arrays of ``path``."""
    known = ranges(spark, path)
    key = F.xxhash64("file").alias("key")
    states = F.broadcast(known.select(key, "at", "inside", "depth"))  # one short row per range, as in csv_splits
    rows = _pieces(spark, path).select(key, "at", "piece").join(states, ["key", "at"], "left")
    found = rows.mapInArrow(_emit(False), _RECORDS).select("record")
    if not known.where("inside or depth > 1").isEmpty():
        cut = stage_table(rows.mapInArrow(_emit(True), _RECORDS), "json_pieces")
        order = Window.partitionBy("key").orderBy("at", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
        begun = cut.withColumn("begun", F.last(F.when(F.col("kind") == BEGINNING, F.col("at")), ignorenulls=True).over(order))
        whole = begun.groupBy("key", "begun").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "record"))).alias("p"))
        found = found.union(whole.select(F.unhex(F.expr("concat(array_join(transform(p, x -> hex(x.record)), '7D'), '7D')")).alias("record")))
    return found.select(F.col("record").cast("string").alias("record"))

"""CSV records from byte ranges: quoted line breaks without giving a file to one task.

Spark's text scan cuts a file into ranges and reads them line by line. Whether a range begins
inside a quoted value depends on everything before it, so two passes are made:

1. Every range is read once under both assumptions (outside, inside). What comes out is one
   row per range: the state it ends in for either start. These are functions on two states
   that compose, so a window over the rows of a file (a running count of the ranges that swap
   the state, and the last range that fixes it) gives the state in which each range begins.
2. Every range is read again from its known state and yields the records that begin and end in
   it. A record that a border cuts leaves its pieces, which are put together by the range in
   which the record begins. This needs a scan of its own and is only done if such a border exists.

The table of ranges has one short row per ``spark.sql.files.maxPartitionBytes`` of input (some
50 MB for 100 TB in 128 MB ranges), which is why it may be broadcast; a join by shuffle would
lose the order of the lines. A range that the first pass has not seen (the session's settings
have changed in between) raises. Lines without quotes, nearly all in most files, pass through
Python as whole Arrow columns.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.sources.sinks import stage_table

_RANGES = "file string, at long, from_outside boolean, from_inside boolean, header binary, bad boolean"
_RECORDS = "key long, at long, kind int, record binary, latin boolean"
#: Kinds of output rows: a whole record, the pieces of one, a record with more fields than the header, one whose quotes never end.
WHOLE, BEGINNING, REST, SURPLUS, UNCLOSED = range(5)
_MARK = b"\xef\xbb\xbf"  # of UTF-8, at the beginning of a file


def scan(line: bytes, inside: bool) -> tuple[bool, int]:
    """(whether the line ends inside quotes, separators outside quotes), from either state.

    A quote opens a value only at its beginning; two quotes inside a quoted value are one.
    """
    pos = seps = 0
    if not inside:
        if line[:1] == b'"':
            pos = 1
        else:
            at = line.find(b',"')
            if at < 0:
                return False, line.count(b",")
            pos, seps = at + 2, line.count(b",", 0, at + 1)
    while True:
        at = line.find(b'"', pos)
        while at >= 0 and line[at + 1:at + 2] == b'"':
            at = line.find(b'"', at + 2)
        if at < 0:
            return True, seps
        pos = line.find(b',"', at + 1)
        if pos < 0:
            return False, seps + line.count(b",", at + 1)
        seps += line.count(b",", at + 1, pos + 1)
        pos += 2


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    place = F.col("_metadata.file_path")
    return spark.read.option("lineSep", "\n").text(path).select(
        place.alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("line"), (~F.is_valid_utf8("value")).alias("bad"))


def _parts(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Batches cut where another range begins; the flag marks the first cut of a range."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        cut = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(cut, cut[1:]):
            part = b.slice(lo, hi - lo)
            here = tuple(part.column(k)[0].as_py() for k in keys)
            yield here != last, part
            last = here


def _quoted(lines: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.match_substring(lines, b'"').to_numpy(zero_copy_only=False))


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 1: a row per range; the header is the first record of a file."""
    rows: list[list] = []
    heading: list[bytes] | None = None
    for new, part in _parts(batches, ["file", "at"]):
        lines = part.column("line")
        if new:
            at = part.column("at")[0].as_py()
            rows.append([part.column("file")[0].as_py(), at, False, True, None, False])
            heading = [] if at == 0 else None
        row = rows[-1]
        row[5] |= bool(pc.any(part.column("bad")).as_py())
        if heading is not None:
            for line in lines.to_pylist():
                line = line if heading else line.removeprefix(_MARK)
                if heading or line.strip(b" \t\r"):
                    heading.append(line)
                    if not scan(b"\n".join(heading), False)[0]:
                        row[4], heading = b"\n".join(heading), None
                        break
        for i in _quoted(lines).tolist():
            line = lines[i].as_py().removeprefix(_MARK)
            a = scan(line, row[2])[0]
            row[2], row[3] = a, a if row[2] == row[3] else scan(line, row[3])[0]
    names = ["file", "at", "from_outside", "from_inside", "header", "bad"]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.bool_()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def ranges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per range with the state it begins in (``inside``) and the one it ends in (``open``), staged."""
    passed = stage_table(_lines(spark, path).mapInArrow(_states, _RANGES), "csv_ranges")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    fixes = F.col("from_outside") == F.col("from_inside")
    swaps = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    swapped = F.coalesce(F.sum(swaps).over(before), F.lit(0))
    counted = passed.withColumn("swapped", swapped)
    known = F.last(F.when(fixes, F.struct(F.col("from_outside").alias("state"), F.col("swapped"))), ignorenulls=True).over(before)
    inside = F.coalesce(known["state"], F.lit(False)) != ((F.col("swapped") - F.coalesce(known["swapped"], F.lit(0))) % 2 == 1)
    latin = F.max("bad").over(Window.partitionBy("file"))
    return stage_table(counted.withColumn("inside", inside).select(
        "file", "at", "inside", F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside")).alias("open"), "header", latin.alias("latin")), "csv_states")


def _emit(fields: int, pieces: bool):
    """Pass 2: records of ranges whose first state is known (``pieces``: what the borders cut, instead)."""
    names = [c.split()[0] for c in _RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []       # lines of the record that goes on
        seps, inside, rest, first, place = 0, False, False, False, None

        def batch(kind: int, records: pa.Array, place: tuple) -> pa.RecordBatch:
            n = len(records)
            return pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(place[0], pa.int64()), n), pa.repeat(pa.scalar(place[1], pa.int64()), n), pa.repeat(pa.scalar(kind, pa.int32()), n),
                 records.cast(pa.binary()), pa.repeat(pa.scalar(place[2], pa.bool_()), n)], names)

        def piece(place: tuple) -> Iterator[pa.RecordBatch]:
            if pieces and held:
                yield batch(REST if rest else BEGINNING, pa.array([b"\n".join(held)], pa.binary()), place)

        for new, part in _parts(batches, ["key", "at"]):
            if new:
                if place:
                    yield from piece(place)
                if part.column("inside")[0].as_py() is None:
                    raise ValueError("The ranges of the files have changed while they were read.")
                place = tuple(part.column(k)[0].as_py() for k in ("key", "at", "latin"))
                held, seps, inside, first = [], 0, part.column("inside")[0].as_py(), place[1] == 0
                rest = inside
            lines, quoted = part.column("line"), _quoted(part.column("line"))
            plain = pc.match_substring_regex(lines, r"[^ \t\r]").to_numpy(zero_copy_only=False)  # blank lines are no records
            more, wide = [], []
            i = 0
            while True:
                if not inside and not first:  # lines without a quote change nothing
                    at = int(np.searchsorted(quoted, i))
                    i = int(quoted[at]) if at < len(quoted) else len(lines)
                if i >= len(lines):
                    break
                line = lines[i].as_py()
                if first and not held:
                    line = line.removeprefix(_MARK)
                if held or inside or line.strip(b" \t\r"):
                    inside, n = scan(line, inside)
                    held.append(line)
                    seps += n
                    if not inside:
                        if rest:
                            yield from piece(place)
                        elif not first:
                            (wide if seps >= fields else more).append(b"\n".join(held))
                        held, seps, rest, first = [], 0, False, False
                plain[i] = False
                i += 1
            if pieces:
                continue
            single = lines.filter(pa.array(plain))
            commas = pc.count_substring(single, b",").to_numpy(zero_copy_only=False)
            for kind, got in ((WHOLE, single.filter(pa.array(commas < fields))), (SURPLUS, single.filter(pa.array(commas >= fields))),
                              (WHOLE, pa.array(more, pa.binary())), (SURPLUS, pa.array(wide, pa.binary()))):
                if len(got):
                    yield batch(kind, got, place)
        if place:
            yield from piece(place)
    return run


def header(known: DataFrame, fallback_encoding: str) -> list[str]:
    """Column names, which all files must share: repeated ones are numbered, empty ones named by their place."""
    text = F.when(F.col("latin"), F.decode("header", fallback_encoding)).otherwise(F.decode("header", "UTF-8"))
    first = known.where("at = 0").agg(F.min(text).alias("a"), F.max(text).alias("b"), F.count_if(F.col("header").isNull()).alias("without")).first()
    if first["a"] is None:
        raise ValueError("The CSV file is empty.")
    if first["without"]:
        raise ValueError("The header of a CSV file is missing, or longer than the first range of the file.")
    if first["a"] != first["b"]:
        raise ValueError("The CSV files have different headers.")
    names: list[str] = []
    for k, name in enumerate(next(csv.reader(io.StringIO(first["a"].removesuffix("\r"), newline="")))):
        name = name if name.strip() else f"Unnamed: {k}"
        unique, n = name, 0
        while unique in names:
            n += 1
            unique = f"{name}.{n}"
        names.append(unique)
    return names


def records(spark: SparkSession, path: str | list[str], known: DataFrame, fields: int) -> DataFrame:
    """(kind, record, latin) of every record but the headers; ``known`` as from :func:`ranges`."""
    key = F.xxhash64("file").alias("key")
    states = F.broadcast(known.select(key, "at", "inside", "latin"))  # one short row per range, see above
    lines = _lines(spark, path).select(key, "at", "line").join(states, ["key", "at"], "left")
    found = lines.mapInArrow(_emit(fields, False), _RECORDS)
    if not known.where("inside or open").isEmpty():
        cut = stage_table(lines.mapInArrow(_emit(fields, True), _RECORDS), "csv_pieces")
        order = Window.partitionBy("key").orderBy("at", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
        begun = cut.withColumn("begun", F.last(F.when(F.col("kind") == BEGINNING, F.col("at")), ignorenulls=True).over(order))
        whole = begun.groupBy("key", "begun").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "record"))).alias("p"), F.max("latin").alias("latin"))
        text = whole.selectExpr("key", "begun AS at", f"{WHOLE} AS kind", "array_join(transform(p, x -> hex(x.record)), '0A') AS hex", "latin")
        joined = text.select("key", "at", "kind", F.unhex("hex").alias("record"), "latin").mapInArrow(_checked(fields), _RECORDS)
        found = found.union(joined)
    return found.select("kind", "record", "latin")


def _checked(fields: int):
    """Kind of the records that were put together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [scan(r, False) for r in b.column("record").to_pylist()]
            kind = [UNCLOSED if open_ else SURPLUS if seps >= fields else WHOLE for open_, seps in read]
            yield b.set_column(2, "kind", pa.array(kind, pa.int32()))
    return run

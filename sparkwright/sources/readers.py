"""Readers: Parquet tables, CSV with per-file encoding fallback, JSON shapes, xlsx workbooks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.sources import csv_splits, json_splits

# Keys that commonly wrap a list of records in a JSON document, in
# preference order.
RECORD_LIST_KEYS = ["records", "data", "items", "rows", "results"]
# Texts that a CSV reader of data frames takes for a missing value.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
           "n/a", "nan", "null"]


def with_scan_row_id(df: DataFrame, out_col: str = "source_row_id") -> DataFrame:
    """Dense 0-based row number in the order of a Parquet table: files by path, then rows as they stand.

    ``df`` must be a scan (``spark.read.parquet``). The scan itself knows a row's place in its
    file; what is added are the rows of the files before it, from one count per file that reads no
    column. Nothing is sorted, shuffled or written; the table of files (one row each) is broadcast, as
    a join that shuffles by file would hand all rows of a file to one task.
    """
    file, place = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place")
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = df.select(file).groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    files = files.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    placed = df.select("*", file, place).join(F.broadcast(files), "_file")
    return placed.withColumn(out_col, F.col("_offset") + F.col("_place")).drop("_file", "_place", "_offset")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table as scanned.

    With the session setting ``sparkwright.spreadScans`` (off by default; for tables written as
    one row group, i.e. one task) rows are dealt round-robin over the cores after the scan.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism) if spark.conf.get("sparkwright.spreadScans", "false") == "true" else df


def normalize_blanks(df: DataFrame, missing: list[str] | None = None) -> DataFrame:
    """Whitespace-only text, and the texts in ``missing``, become null in every string column (one projection)."""
    cols = []
    for field in df.schema.fields:
        name = f"`{field.name}`"
        if isinstance(field.dataType, T.StringType):
            text = ~F.col(name).rlike(r"^\s*$")
            cols.append(F.when(text & ~F.col(name).isin(missing) if missing else text, F.col(name)).alias(field.name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def validate_table(df: DataFrame) -> DataFrame:
    """Reject tables without columns or without rows (``isEmpty`` reads one row)."""
    if len(df.columns) == 0:
        raise ValueError("The loaded table has no columns.")
    if df.isEmpty():
        raise ValueError("The loaded table has no rows.")
    return df


def read_csv(spark: SparkSession, path: str, max_rows: int | None = None,
             fallback_encoding: str = "ISO-8859-1") -> DataFrame:
    """Header CSV, all columns as text; quotes are doubled inside quotes, and quoted values may
    hold line breaks. A file is read by as many tasks as it has ranges (``sources/csv_splits.py``).

    The markers in ``MISSING`` and blank values become null, quoted or not. Short records are
    filled with nulls; a record with more fields than the header, or with quotes that never
    end, raises when it is read; so do files with different headers. Blank lines are skipped.
    A file that is not valid UTF-8, header included, is read with ``fallback_encoding``.
    """
    known = csv_splits.ranges(spark, path)
    names = csv_splits.header(known, fallback_encoding)
    found = csv_splits.records(spark, path, known, len(names))
    whole = F.when(F.col("kind") == csv_splits.WHOLE, F.lit(True))
    for kind, says in ((csv_splits.SURPLUS, f"A record has more than {len(names)} fields: "), (csv_splits.UNCLOSED, "The quotes of a record never end: ")):
        start = F.decode(F.substring("record", 1, 200), "ISO-8859-1")
        whole = whole.when(F.col("kind") == kind, F.raise_error(F.concat(F.lit(says), start)).cast("boolean"))
    text = F.when(F.col("latin"), F.decode("record", fallback_encoding)).otherwise(F.col("record").cast("string"))
    text = F.regexp_replace(text, r"\r\z", "")
    shape = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])
    options = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, len(names) + 1))}
    df = found.where(whole).select(F.from_csv(text, shape.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*").toDF(*names)
    df = normalize_blanks(df, MISSING)
    if max_rows is not None:
        df = df.limit(int(max_rows))
    return validate_table(df)


def flatten_records(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested objects become dotted columns; lists inside a record are rejected."""
    def walk(dtype: T.DataType, path: list[str]):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                yield from walk(f.dataType, path + [f.name])
        elif isinstance(dtype, (T.ArrayType, T.MapType)):
            raise ValueError(f"Column {sep.join(path)} holds a list; only flat or nested objects are supported.")
        else:
            yield path
    cols = []
    for path in walk(df.schema, []):
        ref = F.col(".".join(f"`{p}`" for p in path))
        cols.append(ref.alias(sep.join(path)))
    return df.select(*cols)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines, a top-level array of records, a single object, or one object that wraps a
    list of records (preferred keys first, else the first key holding records).

    An array is read by as many tasks as its file has ranges (``sources/json_splits.py``), lines
    by as many as Spark cuts them into; an object is one task. Otherwise the first line that
    is not blank tells lines (a whole object) from a document. Anything that does not parse
    raises; a list inside a record raises; only a list in a single wrapping object is unwrapped.
    """
    head = spark.read.option("lineSep", "}").text(path).select(F.substring(F.ltrim(F.regexp_replace("value", "^[\ufeff\\s]+", "")), 1, 1).alias("c"))
    first = head.filter(F.col("c") != "").first()
    if first is None:
        raise ValueError("The file is not valid JSON.")
    doc = _json_array(spark, path) if first["c"] == "[" else _json_lines(spark, path)
    return validate_table(normalize_blanks(flatten_records(doc)))


def _json_array(spark: SparkSession, path: str) -> DataFrame:
    """Records of arrays: one pass finds the ranges, one checks every record and unites their shapes, one reads."""
    text = json_splits.records(spark, path)
    value = F.try_parse_json("record")
    found = text.agg(F.schema_of_variant_agg(value).alias("shape"), F.count_if(value.isNull()).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    if found["bad"]:
        raise ValueError("The file is not valid JSON.")
    if not found["n"]:
        raise ValueError("The loaded table has no rows.")
    return text.select(F.from_json("record", _struct_ddl(found["shape"])).alias("r")).select("r.*")


def _struct_ddl(shape: str) -> str:
    """The shape of variants as the type that is read: whole numbers long, others double, mixed kinds text."""
    return re.sub(r"\bOBJECT<", "STRUCT<", re.sub(r"\bDECIMAL\(\d+, ?\d+\)", "DOUBLE", re.sub(r"\b(VOID|VARIANT)\b", "STRING", shape)))


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    head = first["value"].strip()
    lines = head.startswith("{") and _is_object(head)
    shape = spark.read.option("multiLine", not lines).json(path).schema
    if "_corrupt_record" not in shape.names:
        shape = T.StructType([*shape.fields, T.StructField("_corrupt_record", T.StringType())])
    doc = spark.read.schema(shape).option("multiLine", not lines).json(path)
    # the mark is only set where other columns are parsed too
    parsed = F.xxhash64(*[F.col(f"`{c}`") for c in doc.columns if c != "_corrupt_record"])
    if not doc.filter(F.col("_corrupt_record").isNotNull() & (parsed != F.lit(0))).isEmpty():
        raise ValueError("The file is not valid JSON.")
    doc = doc.drop("_corrupt_record")
    lists = [f.name for f in doc.schema.fields
             if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if lists and len(doc.take(2)) == 1:
        chosen = next((k for k in RECORD_LIST_KEYS if k in lists), lists[0])
        doc = doc.select(F.explode(F.col(f"`{chosen}`")).alias("_r")).select("_r.*")
    return doc


def _is_object(text: str) -> bool:
    import json
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def parse_json_column(df: DataFrame, column: str, sep: str = ".") -> DataFrame:
    """JSON objects held in a text column become dotted columns (``props.k``).

    The schema is the union over all rows (one aggregate; what comes back is one line of
    text). Numbers that are fractional somewhere become double, values of mixed kinds text.
    """
    value = F.col(f"`{column}`")
    shape = df.agg(F.schema_of_variant_agg(F.try_parse_json(value)).alias("s")).first()["s"]
    if shape is None or not shape.startswith("OBJECT"):
        return df
    parsed = df.withColumn(column, F.from_json(value, _struct_ddl(shape)))
    others = [F.col(f"`{c}`") for c in df.columns if c != column]
    leaf = [F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path))
            for path in _leaf_paths(parsed.schema[column].dataType, [column], sep)]
    return parsed.select(*others, *leaf)


def _leaf_paths(dtype: T.DataType, path: list[str], sep: str):
    if isinstance(dtype, T.StructType):
        for f in dtype.fields:
            yield from _leaf_paths(f.dataType, path + [f.name], sep)
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        raise ValueError(f"Column {sep.join(path)} holds a list; only flat or nested objects are supported.")
    else:
        yield path


def read_xlsx_files(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Directory of .xlsx workbooks -> rows of (_file, _sheet, row_no, col_no, value).

    Each workbook is parsed inside a task (stdlib zip + XML); many files spread over many
    tasks. ``.xls`` files are refused. The long layout keeps the schema fixed; pivot the
    header row into columns with :func:`xlsx_to_table`.
    """
    from sparkwright.sources.xlsx import parse_workbooks
    legacy = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls").load(path).select("path")
    if not legacy.isEmpty():
        raise ValueError("Legacy .xls workbooks are not supported; save them as .xlsx.")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    schema = "_file string, _sheet string, row_no int, col_no int, value string"
    return files.select("path", "content").mapInPandas(lambda it: parse_workbooks(it, sheet), schema)


def xlsx_to_table(cells: DataFrame) -> DataFrame:
    """Long cells -> one table: row 1 holds the headers, later rows the records.

    The header row is one bounded row per workbook column; the pivot uses those
    fixed column numbers, so the reshaping runs on the executors.
    """
    header = {r["col_no"]: r["value"] for r in cells.filter(F.col("row_no") == 1)
              .groupBy("col_no").agg(F.min("value").alias("value")).collect()}
    cols = sorted(header)
    body = cells.filter(F.col("row_no") > 1)
    wide = body.groupBy("_file", "_sheet", "row_no").pivot("col_no", cols).agg(F.first("value"))
    return normalize_blanks(wide.select("_file", "_sheet", *[F.col(f"`{c}`").alias(header[c] or f"column_{c}")
                                                             for c in cols]))

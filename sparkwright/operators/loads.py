"""Table fingerprints across loads: files are hashed once, equal tables are named.

A file's mark is its row count with the XOR and the sum of its row keys. Marks add up, so a
table's mark does not depend on the order of its rows or how they are cut into files. Marks are
kept in a catalogue (a published table); a load lists the files, hashes those it has not seen
with this time and size, and adds their marks up with the stored ones.

Defined cases: a table without rows has row count 0 and no hashes; files that are gone leave
the catalogue; a file written anew is hashed anew; repeated rows count as often as they stand.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.operators.profile import row_key, schema_text
from sparkwright.sources.sinks import PUBLISHED, read_written, write_table

_FILE = ["name", "file", "modified", "size"]
_MARKS = "name string, file string, modified timestamp, size long, rows long, hash_xor long, hash_sum decimal(38,0), schema string"


def _place(name: str) -> list:
    meta = {"file": "file_path", "modified": "file_modification_time", "size": "file_size"}
    return [F.lit(name).alias("name"), *(F.col(f"_metadata.{m}").alias(c) for c, m in meta.items())]


def list_files(spark: SparkSession, name: str, path: str) -> DataFrame:
    """(name, file, modified, size) of a table's files; their content is not read."""
    return spark.read.format("binaryFile").load(path).select(*_place(name))


def file_marks(df: DataFrame, name: str) -> DataFrame:
    """One mark per file of a scan."""
    keyed = df.select(*_place(name), row_key(df).alias("key"))
    return keyed.groupBy(*_FILE).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("key").alias("hash_xor"),
                                     F.sum(F.col("key").cast("decimal(28,0)")).alias("hash_sum")).withColumn("schema", F.lit(schema_text(df)))


def _catalogue(spark: SparkSession, folder: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, PUBLISHED))
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], _MARKS)
    return read_written(spark, folder)


def load(spark: SparkSession, folder: str, tables: dict[str, str]) -> tuple[DataFrame, int]:
    """Bring the catalogue in ``folder`` up to date with the Parquet ``tables`` (name -> path).

    Returns (name, row_count, hash_xor, hash_sum, schema, same_as) and the number of files
    that were hashed. ``same_as`` is the first name that has the same rows.
    """
    old = _catalogue(spark, folder)
    listings = {name: list_files(spark, name, path) for name, path in tables.items()}
    marks, hashed = [], 0
    for name, files in listings.items():
        # names of files only; the driver lists them for any scan
        new = [r["file"] for r in files.join(old, _FILE, "left_anti").select("file").collect()]
        marks.append(old.join(files, _FILE, "left_semi").select(*spark.createDataFrame([], _MARKS).columns))
        if new:
            marks.append(file_marks(spark.read.parquet(*new), name))
            hashed += len(new)
    kept = marks[0]
    for more in marks[1:]:
        kept = kept.unionByName(more)
    write_table(kept.coalesce(max(1, len(tables))), folder)
    return table_marks(read_written(spark, folder), list(tables)), hashed


def table_marks(marks: DataFrame, names: list[str]) -> DataFrame:
    """File marks added up per table, with the first table of the same mark."""
    added = marks.groupBy("name").agg(F.sum("rows").alias("row_count"), F.bit_xor("hash_xor").alias("hash_xor"),
                                      F.sum("hash_sum").cast("string").alias("hash_sum"), F.min("schema").alias("schema"))
    every = marks.sparkSession.createDataFrame([(n,) for n in names], "name string").join(added, "name", "left")
    every = every.withColumn("row_count", F.coalesce("row_count", F.lit(0)).cast("long"))
    same = Window.partitionBy("row_count", "hash_xor", "hash_sum", "schema")  # a row per table
    return every.withColumn("same_as", F.when(F.min("name").over(same) != F.col("name"), F.min("name").over(same)))

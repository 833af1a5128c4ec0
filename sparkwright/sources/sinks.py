"""Sinks: table writes, multi-table export bundles, stacked previews, KPI long form,
project save/restore and named SQL.

Everything is written by the executors into new version folders; the driver only sees bounded
manifests (one row per written table). A manifest is replaced by one rename when all
is written, and tables are read through it, so a write that fails half way changes nothing.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkwright.session import scratch_root

# Export layout.
FORMATS = ["parquet", "csv", "json"]


def scratch_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh folder in the session's shared location, removed when the session ends."""
    path = os.path.join(scratch_root(spark), *parts, uuid.uuid4().hex)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh shared folder and read back: its rows and their order are fixed."""
    path = scratch_dir(df.sparkSession, "staged", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What names the current version of everything under a folder.
PUBLISHED = "published.json"


def _publish(spark: SparkSession, folder: str, content: dict) -> None:
    """Replace the folder's manifest by one rename: readers see the old one or the new one, whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    target = hadoop.Path(os.path.join(folder, PUBLISHED))
    draft = hadoop.Path(os.path.join(folder, f".{PUBLISHED}.{uuid.uuid4().hex}"))
    out = draft.getFileSystem(conf).create(draft, True)
    try:
        out.write(bytearray(json.dumps(content, default=str).encode()))
    finally:
        out.close()
    replace = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    replace[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(draft.getFileSystem(conf).getUri(), conf).rename(draft, target, replace)


def published(spark: SparkSession, folder: str) -> dict:
    """The manifest of a folder: the last write that ended."""
    return json.loads(spark.read.text(os.path.join(folder, PUBLISHED), wholetext=True).first()["value"])


def _write_version(df: DataFrame, path: str, fmt: str) -> str:
    """``df`` in a new version folder under ``path``; nothing that is there is touched."""
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported export format: {fmt}")
    version = os.path.join(path, f"v-{uuid.uuid4().hex}")
    w = df.write
    if fmt == "csv":
        w.option("header", True).option("escape", '"').option("timestampFormat", "yyyy-MM-dd HH:mm:ss")\
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(version)
    elif fmt == "json":
        w.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss")\
            .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").json(version)
    else:
        w.parquet(version)
    return version


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """CSV (header, ISO timestamps), JSON records (ISO timestamps) or Parquet, as a new version under ``path``.

    The version is published when all of it is written; until then, and after a failure,
    :func:`read_written` gives the one before. Returns the folder of the new version.
    """
    version = _write_version(df, path, fmt)
    _publish(df.sparkSession, path, {"version": version, "format": fmt})
    return version


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """The published version of a table."""
    from sparkwright.sources.readers import read_csv, read_json
    at = published(spark, path)
    return {"csv": read_csv, "json": read_json}.get(at["format"], lambda s, p: s.read.parquet(p))(spark, at["version"])


def remove_unpublished(spark: SparkSession, folder: str) -> int:
    """Delete the versions under a folder that its manifest does not name (old ones, and those of failed writes)."""
    text = json.dumps(published(spark, folder))
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    gone, todo = 0, [top]
    while todo:
        for found in fs.listStatus(todo.pop()):
            name = found.getPath().getName()
            if found.isDirectory() and name.startswith("v-"):
                if name not in text:
                    gone += bool(fs.delete(found.getPath(), True))
            elif found.isDirectory():
                todo.append(found.getPath())
    return gone


def clean_name(name: str, taken: set[str]) -> str:
    """File-system-safe table name, de-duplicated with a numeric suffix."""
    base = re.sub(r"[^A-Za-z0-9_]+", "_", name).strip("_") or "table"
    out, i = base, 2
    while out in taken:
        out, i = f"{base}_{i}", i + 1
    taken.add(out)
    return out


def _write_bundle(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str, fmt: str) -> list[tuple]:
    taken: set[str] = set()
    manifest = []
    for name, df in tables.items():
        safe = clean_name(name, taken)
        obs = Observation(f"rows_{safe}_{uuid.uuid4().hex[:6]}")
        version = _write_version(df.observe(obs, F.count(F.lit(1)).alias("rows")), os.path.join(out_dir, safe), fmt)
        manifest.append((safe, int(obs.get["rows"]), len(df.columns), version, fmt))
    return manifest


_MANIFEST = "table string, rows long, columns int, path string, format string"


def _described(manifest: list[tuple]) -> dict:
    return {"tables": [dict(zip((c.split()[0] for c in _MANIFEST.split(", ")), row)) for row in manifest]}


def export_bundle(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> DataFrame:
    """Write every table under ``out_dir`` and return the manifest (table, rows, columns,
    path, format). Row counts are observed during the write: no second scan. All tables
    are published together, by one manifest, when the last is written."""
    manifest = _write_bundle(spark, tables, out_dir, fmt)
    _publish(spark, out_dir, _described(manifest))
    return spark.createDataFrame(manifest, _MANIFEST)


def read_bundle(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The published tables of a bundle by name."""
    from sparkwright.sources.readers import read_csv, read_json
    readers = {"csv": read_csv, "json": read_json, "parquet": lambda s, p: s.read.parquet(p)}
    return {t["table"]: readers[t["format"]](spark, t["path"]) for t in published(spark, out_dir)["tables"]}


def pack_tables(tables: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Stack result tables (all rows, or the first ``limit`` each) with a ``source_table`` column."""
    parts = [(df if limit is None else df.limit(limit)).select(
        F.lit(name).alias("source_table"), *[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
        for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: Spark removes a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """A small result, written; the shuffle files of its query go when it ends, so that they never lie beside the next one's."""
    conf = df.sparkSession.conf
    before = conf.get(_SHUFFLE_CLEANUP, None)
    conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        return stage_table(df, name)
    finally:
        conf.set(_SHUFFLE_CLEANUP, before) if before is not None else conf.unset(_SHUFFLE_CLEANUP)


def kpi_long(metrics: dict[str, DataFrame]) -> DataFrame:
    """One-row metric tables -> (source, metric, value) rows. The tables are worked out one after the other when this is called."""
    parts = []
    for source, row in metrics.items():
        typed = settle(row.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in row.columns]), "kpis")
        parts.append(typed.unpivot([], typed.columns, "metric", "value")
                     .select(F.lit(source).alias("source"), "metric", "value"))
    return reduce(DataFrame.unionByName, parts)


def save_project(spark: SparkSession, out_dir: str, cleaned: DataFrame, steps: list, mapping: dict,
                 quality: DataFrame | None = None) -> DataFrame:
    """Cleaned table (Parquet) + step log + mapping + quality row, published by one manifest."""
    tables = {"cleaned_data": cleaned}
    if quality is not None:
        tables["quality"] = quality
    manifest = _write_bundle(spark, tables, out_dir, "parquet")
    meta = {"steps": [{"op": s.op, "args": list(s.args), "kwargs": s.kwargs} for s in steps], "mapping": mapping}
    _publish(spark, out_dir, _described(manifest) | {"project": meta})
    return spark.createDataFrame(manifest, _MANIFEST)


def restore_project(spark: SparkSession, out_dir: str) -> tuple[DataFrame, list, dict]:
    """The published state of a project: the cleaned table with its step log and mapping."""
    from sparkwright.operators.prepare import Step
    meta = published(spark, out_dir)["project"]
    steps = [Step(s["op"], tuple(s["args"]), s.get("kwargs", {})) for s in meta["steps"]]
    return read_bundle(spark, out_dir)["cleaned_data"], steps, meta["mapping"]


def run_named_sql(spark: SparkSession, sql_text: str, **frames: DataFrame) -> DataFrame:
    """Run SQL text with DataFrames bound to ``{name}`` placeholders."""
    return spark.sql(sql_text, **frames)

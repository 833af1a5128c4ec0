"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as
the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sparkwright.llm.common import read, stage
from sparkwright.llm.line_dedup import dedup_lines
from sparkwright.llm.packing_nnls import pack
from sparkwright.llm.quality_knn import keep_good
from sparkwright.llm.simhash_bytes import MAX_BITS, SHINGLE, keep_one
from sparkwright.llm.suffix_dedup import cut
from sparkwright.session import configure


def _configured(fn):
    """A stage under the session's settings, also where it is called by itself."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return fn(configure(spark), docs, sf_dir)
    return run_stage


@_configured
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at or above its threshold."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


@_configured
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand, alike or nearly, elsewhere."""
    return dedup_lines(docs)


@_configured
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs, SHINGLE, MAX_BITS)


@_configured
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of 200-byte strings that stand elsewhere."""
    return cut(docs)


@_configured
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 4096."""
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]
#: SQL can express neither the classifier nor the fuzzy lines; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

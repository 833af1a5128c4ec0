"""Writes are published at their end: a write that fails half way leaves the version before."""

import os

import pytest
from pyspark.sql import functions as F

from sparkwright.operators.prepare import Step
from sparkwright.sources import sinks as SK


def _failing(spark):
    """Half of the rows are written before a task fails."""
    return spark.range(0, 1000, numPartitions=4).select(
        F.when(F.col("id") == 900, F.raise_error(F.lit("lost half way")).cast("long")).otherwise(F.col("id")).alias("id"))


@pytest.mark.parametrize("fmt", SK.FORMATS)
def test_a_failed_write_leaves_the_old_table(spark, tmp_path, fmt):
    path = str(tmp_path / "t")
    SK.write_table(spark.range(3), path, fmt)
    with pytest.raises(Exception, match="lost half way"):
        SK.write_table(_failing(spark), path, fmt)
    assert sorted(int(r["id"]) for r in SK.read_written(spark, path).collect()) == [0, 1, 2]
    SK.write_table(spark.range(5), path, fmt)
    assert SK.read_written(spark, path).count() == 5
    assert SK.remove_unpublished(spark, path) >= 1 and SK.read_written(spark, path).count() == 5
    assert sum(d.startswith("v-") for d in os.listdir(path)) == 1


def test_a_table_can_replace_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    SK.write_table(spark.range(4), path)
    SK.write_table(SK.read_written(spark, path).where("id > 1"), path)
    assert SK.read_written(spark, path).count() == 2


def test_bundles_and_projects_are_published_whole(spark, tmp_path):
    out, project = str(tmp_path / "b"), str(tmp_path / "p")
    SK.export_bundle(spark, {"a": spark.range(2), "b": spark.range(3)}, out)
    with pytest.raises(Exception, match="lost half way"):
        SK.export_bundle(spark, {"a": spark.range(7), "b": _failing(spark)}, out)
    assert {k: v.count() for k, v in SK.read_bundle(spark, out).items()} == {"a": 2, "b": 3}
    step = Step("drop_duplicates", (), {})
    SK.save_project(spark, project, spark.range(6), [step], {"order_id": "id"})
    with pytest.raises(Exception, match="lost half way"):
        SK.save_project(spark, project, spark.range(1), [], {}, quality=_failing(spark))
    cleaned, steps, mapping = SK.restore_project(spark, project)
    assert cleaned.count() == 6 and [s.op for s in steps] == ["drop_duplicates"] and mapping == {"order_id": "id"}

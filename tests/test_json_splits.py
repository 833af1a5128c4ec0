"""JSON arrays cut into ranges: objects across borders, and what is no array of objects."""

import json

import numpy as np
import pytest

from sparkwright.sources import json_splits
from sparkwright.sources import readers as RD


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "600", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _records(n):
    g = np.random.default_rng(2)
    parts = ['a "q" ', "}", "{", "[", "]", "\\", ",", "\n", "é漢", "plain ", '\\"', "},{"]
    rows = [{"id": k, "t": "".join(g.choice(parts, int(g.integers(0, 7)))) + ".", "o": {"x": k / 2, "deep": {"y": "}" * (k % 3) + "_"}}} for k in range(n)]
    rows[20]["t"] = "}{" * 900
    return rows


@pytest.mark.parametrize("shape", ["one line", "indented"])
def test_objects_across_borders(spark, tmp_path, small_ranges, shape):
    rows = _records(60)
    text = json.dumps(rows, ensure_ascii=False, indent=2 if shape == "indented" else None)
    (tmp_path / "a.json").write_text(text + "\n", encoding="utf-8")
    df = RD.read_json(spark, str(tmp_path / "a.json"))
    assert sorted(df.columns) == ["id", "o.deep.y", "o.x", "t"] and dict(df.dtypes)["id"] == "bigint"
    got = {r["id"]: (r["t"], r["o.x"], r["o.deep.y"]) for r in df.collect()}
    assert got == {r["id"]: (r["t"], r["o"]["x"], r["o"]["deep"]["y"]) for r in rows}
    assert json_splits._pieces(spark, str(tmp_path / "a.json")).rdd.getNumPartitions() >= 8


def test_flat_objects_need_no_third_scan(spark, tmp_path, small_ranges):
    (tmp_path / "f.json").write_text(json.dumps([{"a": k, "b": None if k % 2 else k + 0.5} for k in range(300)]))
    assert json_splits.ranges(spark, str(tmp_path / "f.json")).where("inside or depth > 1").isEmpty()
    assert RD.read_json(spark, str(tmp_path / "f.json")).selectExpr("sum(a)", "sum(b)").first() == (44850, sum(k + 0.5 for k in range(0, 300, 2)))


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2}', '[{"a": 1} {"a": 2}]', '[{"a": 1}, 5]', '[5, {"a": 1}]', '[{"a": 1}]]', '[{"a": 1}], {"b": 2}', '[{"a": "x}]',
                                  '[{"a": 1}, {"a": }]', '[{"a": [1, 2]}]', '[[{"a": 1}]]', "[]", '[{"a": 1]}', '[{"a": 1}][{"a": 2}]', "[1, 2]"])
def test_what_is_no_array_of_records_raises(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="valid JSON|holds a list|no rows"):
        RD.read_json(spark, str(tmp_path / "bad.json")).collect()

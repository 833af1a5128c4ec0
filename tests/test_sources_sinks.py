"""Readers, sinks and summaries."""

import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from conftest import one, rows
from sparkwright.operators import summary as S
from sparkwright.sources import readers as RD
from sparkwright.sources import sinks as SK


def test_csv_blanks_and_latin1_fallback(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,city\nAnn,  \nBob,Paris\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("name,city\nZoë,Köln\n".encode("latin-1"))
    out = [(r["name"], r["city"]) for r in rows(RD.read_csv(spark, str(tmp_path)))]
    assert ("Ann", None) in out and ("Zoë", "Köln") in out
    assert RD.read_csv(spark, str(tmp_path), max_rows=1).count() == 1


def test_json_shapes(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a": 1, "b": {"c": "x"}}\n{"a": 2, "b": {"c": "y"}}\n')
    df = RD.read_json(spark, str(tmp_path / "lines.json"))
    assert sorted(df.columns) == ["a", "b.c"] and df.count() == 2
    (tmp_path / "wrapped.json").write_text(json.dumps({"meta": 1, "records": [{"a": 1}, {"a": 2}, {"a": 3}]}))
    assert RD.read_json(spark, str(tmp_path / "wrapped.json")).count() == 3
    (tmp_path / "array.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert RD.read_json(spark, str(tmp_path / "array.json")).count() == 2
    (tmp_path / "bad.json").write_text(json.dumps([{"a": [1, 2]}]))
    with pytest.raises(ValueError):
        RD.read_json(spark, str(tmp_path / "bad.json"))


def test_json_loses_no_row(spark, tmp_path):
    (tmp_path / "one_bad.json").write_text('{"a": 1}\n{"a": 2}\n{"a": \n{"a": 4}\n')
    with pytest.raises(ValueError):
        RD.read_json(spark, str(tmp_path / "one_bad.json"))
    (tmp_path / "lists.json").write_text('{"id": 1, "items": [{"x": 1}]}\n{"id": 2, "items": []}\n')
    with pytest.raises(ValueError):
        RD.read_json(spark, str(tmp_path / "lists.json"))


def test_json_column_schema_covers_all_rows(spark):
    df = spark.createDataFrame([('{"k": 1}',), ('{"k": 2.5, "z": "hello"}',), ('{"z": "only"}',), (None,)], "p string")
    got = [(r["p.k"], r["p.z"]) for r in rows(RD.parse_json_column(df, "p"))]
    assert got == [(1.0, None), (2.5, "hello"), (None, "only"), (None, None)]


def test_csv_as_pandas_reads_it(spark, tmp_path):
    import pandas as pd
    text = 'name,note\n"say ""hi"", ok","two\nlines"\ncafé,\ufffd kept\n'
    (tmp_path / "u.csv").write_text(text, encoding="utf-8")
    got = sorted((r["name"], r["note"]) for r in rows(RD.read_csv(spark, str(tmp_path / "u.csv"))))
    assert got == sorted(map(tuple, pd.read_csv(tmp_path / "u.csv").values.tolist()))
    (tmp_path / "l.csv").write_bytes("größe,ort\n1,Köln\n".encode("latin-1"))
    assert [r.asDict() for r in RD.read_csv(spark, str(tmp_path / "l.csv")).collect()] == [{"größe": "1", "ort": "Köln"}]
    df = spark.createDataFrame([('a "b", c\nd', "x")], "p string, q string")
    path = SK.write_table(df, str(tmp_path / "out"), "csv")
    import glob
    assert pd.concat(map(pd.read_csv, glob.glob(path + "/*.csv"))).values.tolist() == [['a "b", c\nd', "x"]]


def _write_xlsx(path):
    sheet = ('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
             '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>qty</t></is></c></row>'
             '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>3</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(path, "w") as zf:
        zf.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
                    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
                    '<sheet name="Orders" sheetId="1" r:id="rId1"/></sheets></workbook>')
        zf.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/'
                    '2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        zf.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                    '<si><t>product</t></si><si><t>Widget</t></si></sst>')
        zf.writestr("xl/worksheets/sheet1.xml", sheet)


def test_xlsx_reader(spark, tmp_path):
    _write_xlsx(tmp_path / "book.xlsx")
    table = RD.xlsx_to_table(RD.read_xlsx_files(spark, str(tmp_path)))
    r = one(table)
    assert r["_sheet"] == "Orders" and r["product"] == "Widget" and r["qty"] == "3"
    (tmp_path / "old.xls").write_bytes(b"legacy")
    with pytest.raises(ValueError):
        RD.read_xlsx_files(spark, str(tmp_path))


def test_bundle_pack_and_kpi_long(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "n long, s string")
    b = spark.createDataFrame([(1.5,)], "v double")
    manifest = {r["table"]: r["rows"] for r in rows(SK.export_bundle(spark, {"a table": a, "a-table": b},
                                                                     str(tmp_path / "out")))}
    assert manifest == {"a_table": 2, "a_table_2": 1}
    assert os.path.isdir(tmp_path / "out" / "a_table")
    packed = SK.pack_tables({"a": a, "b": b}, limit=1)
    assert packed.count() == 2 and "source_table" in packed.columns
    long = rows(SK.kpi_long({"k": spark.createDataFrame([(1.0, 2.0)], "x double, y double")}))
    assert {(r["metric"], r["value"]) for r in long} == {("x", 1.0), ("y", 2.0)}


def test_summary_lines(spark):
    k = spark.createDataFrame([(900.0, 250.0, 650.0, 0.7222, 3.0, 383.33, -50.0)],
                              "total_revenue double, total_cost double, net_result double, margin double, "
                              "transaction_count double, average_transaction_amount double, budget_variance double")
    cats = spark.createDataFrame([("B", "cost", 250.0, 1), ("A", "revenue", 900.0, 2)],
                                 "category string, normalized_type string, amount double, transaction_count long")
    issues = spark.createDataFrame([("Duplicate rows", 1, "Medium", "x")],
                                   "issue string, row_count long, severity string, analysis_handling string")
    text = [r["text"] for r in rows(S.finance(k, cats, issues).orderBy("line_no"))]
    assert text[2] == "Total revenue is $900 and total cost is $250."
    assert text[5] == "Budget variance is -$50 where budget and actual fields are available."
    assert text[6] == "The largest mapped category is A with $900."


def test_kpi_long_leaves_no_shuffle_files(spark):
    """Each table is worked out by itself, and its shuffle files go when it is."""
    env = spark._jvm.org.apache.spark.SparkEnv
    blocks = lambda: {b for b in env.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if b.startswith("shuffle")}
    table = lambda k: spark.range(5000).groupBy((F.col("id") % k).alias("g")).count().agg(F.sum("count").alias("n"), F.max("g").alias("g"))
    before = blocks()
    long = SK.kpi_long({"a": table(7), "b": table(11)})
    assert sorted(tuple(r) for r in long.collect()) == [("a", "g", 6.0), ("a", "n", 5000.0), ("b", "g", 10.0), ("b", "n", 5000.0)]
    end = time.time() + 10  # they are removed in the background
    while blocks() - before and time.time() < end:
        time.sleep(0.2)
    assert not blocks() - before
    assert spark.conf.get(SK._SHUFFLE_CLEANUP, None) is None

"""CSV files cut into ranges: records across borders, missing markers, surplus fields."""

import csv
import io

import numpy as np
import pandas as pd
import pytest

from sparkwright.sources import csv_splits
from sparkwright.sources import readers as RD


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _same_as_pandas(spark, path):
    got = RD.read_csv(spark, str(path))
    want = pd.read_csv(path, dtype=str)
    want = [tuple(None if pd.isna(v) or not v.strip() else v for v in r) for r in want.itertuples(index=False)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    return got


def _written(path, rows, names, quoting=csv.QUOTE_MINIMAL, end="\n"):
    out = io.StringIO(newline="")
    w = csv.writer(out, quoting=quoting, lineterminator=end)
    w.writerow(names)
    w.writerows(rows)
    path.write_bytes(out.getvalue().encode())


def test_scan_of_a_line_agrees_with_the_csv_module():
    g = np.random.default_rng(0)
    for _ in range(3000):
        line = "".join(g.choice(list('a,",b "'), int(g.integers(0, 14))))
        open_, seps = csv_splits.scan(line.encode(), False)
        closed = line + '"' if open_ else line
        if line:
            assert len(next(csv.reader([closed]))) == seps + 1, line
        again, more = csv_splits.scan(b'x",' + line.encode(), True)  # the same line, begun inside a value
        assert (again, more) == (open_, seps + 1), line


def test_records_across_borders(spark, tmp_path, small_ranges):
    g = np.random.default_rng(1)
    words = ["plain", 'say ""', '"', "a,b", "line\nbreak", "two\r\nends", "\n", "", "é漢", 'end"\n"', "x" * 90, "NA ", " null"]
    rows = [[str(k), *(" ".join(g.choice(words, int(g.integers(0, 5)))) for _ in range(2))] for k in range(120)]
    rows[37][1] = "long value\n" * 150  # longer than several ranges
    rows[38][2] = "x" * 2000
    for name, quoting, end in (("a", csv.QUOTE_MINIMAL, "\n"), ("c", csv.QUOTE_ALL, "\r\n")):
        _written(tmp_path / f"{name}.csv", rows, ["id", "p", "q"], quoting, end)
        got = _same_as_pandas(spark, tmp_path / f"{name}.csv")
        tasks = csv_splits._lines(spark, str(tmp_path / f"{name}.csv")).rdd.getNumPartitions()
        assert tasks > 10 and got.count() == 120


def test_every_place_of_a_border(spark, tmp_path):
    """A line break and a doubled quote at every offset from a border."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = [["1", 'a ""\n"" b\n'], ["2", '""'], ["3", "c"], ["4", "\n\n"]]
        _written(tmp_path / "x.csv", rows, ["id", "text"])
        for size in (8, 11):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            assert sorted(map(tuple, RD.read_csv(spark, str(tmp_path / "x.csv")).collect())) == [("1", 'a ""\n"" b\n'), ("2", '""'), ("3", "c"), ("4", None)], size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_missing_markers_and_headers_like_pandas(spark, tmp_path):
    text = '﻿a,a,,"b ""x"""\n1,NA,"null",N/A\n\n2,"NaN",n/a\n  \n3,None,<NA>,-1.#IND\n4, NA,NULLS,"none"\n'
    (tmp_path / "m.csv").write_text(text, encoding="utf-8")
    got = _same_as_pandas(spark, tmp_path / "m.csv")
    assert got.columns == list(pd.read_csv(tmp_path / "m.csv").columns) == ["a", "a.1", "Unnamed: 2", 'b "x"']


@pytest.mark.parametrize("text", ["a,b\n1,2\n1,2,3\n", 'a,b\n1,"x\ny",3\n', 'a,b\n1,"x\n', "", "\n \n"])
def test_no_field_is_lost(spark, tmp_path, text, small_ranges):
    (tmp_path / "s.csv").write_text(text)
    with pytest.raises(Exception, match="fields|never end|empty"):
        RD.read_csv(spark, str(tmp_path / "s.csv")).collect()


def test_files_must_share_their_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("a,c\n1,2\n")
    with pytest.raises(ValueError, match="headers"):
        RD.read_csv(spark, str(tmp_path))

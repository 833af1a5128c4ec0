"""Generic aggregation, profiling and the data dictionary."""

import pytest

from conftest import one, rows
from sparkwright.operators import dictionary as DICT
from sparkwright.operators import generic as G
from sparkwright.operators import profile as PR


def test_generic_groups_and_insights(spark):
    df = spark.createDataFrame([("2025-01-01", "A", 10), ("2025-01-15", "A", 20), ("2025-02-01", "B", 5)],
                               "date string, category string, value long")
    agg = G.aggregate(df, "value", "sum", "category", "date")
    out = rows(agg)
    assert {r["category"] for r in out} == {"A", "B"} and sum(r["value"] for r in out) == 35
    text = [r["text"] for r in rows(G.insights(df, agg, ["value"], "sum", "category", "date"))]
    assert text[0] == "Rows used: 3." and any("Highest category" in t for t in text)


def test_generic_multiple_measures_and_long(spark):
    df = spark.createDataFrame([("A", 10, 2), ("A", 20, 3), ("B", 5, 7)], "category string, value long, cost long")
    agg = G.aggregate(df, ["value", "cost"], "sum", "category")
    a = [r for r in rows(agg) if r["category"] == "A"][0]
    assert a["value"] == 30 and a["cost"] == 5
    long = G.long_form(agg, ["category", "missing"], ["value", "category", "cost"])
    assert long.count() == 4 and "metric_value" in long.columns
    with pytest.raises(ValueError):
        G.aggregate(df, ["value"], "median")


def test_profile_tables(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "x"), ("2", "2024-01-02", "x"), ("2", "2024-01-02", None)],
                               "n string, d string, c string")
    kinds = {r["column"]: r["kind"] for r in rows(PR.detect_types(df))}
    assert kinds == {"n": "numeric", "d": "date", "c": "categorical"}
    ov = one(PR.overview(df))
    assert ov["row_count"] == 3 and ov["duplicate_row_count"] == 0
    miss = {r["column"]: r["missing_count"] for r in rows(PR.missing_table(df))}
    assert miss == {"n": 0, "d": 0, "c": 1}
    cat = one(PR.categorical_summary(PR.value_counts(df, ["c"]), ["c"]))
    assert cat["most_common"] == "x" and cat["most_common_count"] == 2


def test_dictionary_notes(spark):
    df = spark.createDataFrame([(0, "id1", "10"), (1, "id2", "-5"), (2, "id3", None)],
                               "rid long, customer_id string, amount string")
    d = {r["column_name"]: r for r in rows(DICT.generate(df, {"sales_retail": {"customer_id": "customer_id"}},
                                                          ["rid"], ["customer_id", "amount"]))}
    assert "Potential identifier column" in d["customer_id"]["quality_notes"]
    assert "Mapped to required template field" in d["customer_id"]["quality_notes"]
    assert d["customer_id"]["example_values"] == "id1, id2, id3"
    assert d["amount"]["missing_value_count"] == 1

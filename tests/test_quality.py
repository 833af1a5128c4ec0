"""Quality score, template rules and issue rows on generated tables."""

import numpy as np
import pandas as pd
import pytest

from conftest import one, rows
from sparkwright.operators import quality as Q
from sparkwright.templates import RETAIL_REQUIRED


@pytest.fixture(scope="module")
def ledger():
    rng = np.random.default_rng(8)
    n = 80
    return pd.DataFrame({
        "order_id": [f"R{i}" for i in range(n)], "order_date": [("2022-08-09" if k else "soon") for k in rng.integers(0, 9, n)],
        "customer_id": [f"c{k}" if k else None for k in rng.integers(0, 5, n)], "product_name": [f"p{k}" if k else "" for k in rng.integers(0, 6, n)],
        "quantity": rng.integers(-1, 4, n), "unit_price": rng.integers(0, 7, n)})


def test_score_counts(spark, ledger):
    row = Q.score(spark.createDataFrame(ledger), {c: c for c in ledger.columns}, RETAIL_REQUIRED, ["order_date"], ["quantity", "unit_price"])
    s = one(row)
    assert s["date_parse_failures"] == (ledger.order_date == "soon").sum()
    assert s["schema_completeness_score"] == 100 and 0 < s["overall_score"] < 100
    notes = [r["value"] for r in rows(Q.score_report(row)) if r["section"] == "explanation"]
    assert len(notes) == 5
    assert notes[3].startswith("Schema completeness: 100.0%") and notes[4].startswith(f"Date parsing: {s['date_parse_failures']} failures")
    other = [r["value"] for r in rows(Q.score_report(row, schema_assessed=False, date_assessed=False)) if r["section"] == "explanation"]
    assert other[3].endswith("domain template is selected.") and "not assessed" in other[4]


def test_generic_score_skips_schema(spark):
    s = one(Q.score(spark.createDataFrame([("A", 1), (None, 2)], "name string, value long")))
    assert s["schema_completeness_score"] is None and s["missing_cells"] == 1


def test_sales_rule_counts(spark, ledger):
    rules = Q.template_rules(spark.createDataFrame(ledger), "sales_retail", {c: c for c in ledger.columns})
    got = {r["rule_name"]: r["affected_rows_count"] for r in rows(rules)}
    assert got["quantity equals zero"] == (ledger.quantity == 0).sum()
    assert got["negative quantity potential return"] == (ledger.quantity < 0).sum()
    assert got["unit_price <= 0"] == (ledger.unit_price <= 0).sum()
    assert got["missing customer_id"] == ledger.customer_id.isna().sum()
    assert got["missing product_name"] == (ledger.product_name == "").sum()


def test_finance_rule_counts(spark):
    amounts = ["12.5", "0", "x", None, "0.0", "7"]
    kinds = ["cost", "Revenue", "gift", "cost", "?", "cost"]
    df = spark.createDataFrame(list(zip(["2021-02-03"] * 6, amounts, kinds)), "d string, a string, t string")
    got = {r["rule_name"]: r["affected_rows_count"] for r in rows(Q.template_rules(df, "finance", {"date": "d", "amount": "a", "type": "t"}))}
    number = pd.to_numeric(pd.Series(amounts), errors="coerce")
    assert got["amount missing or non-numeric"] == number.isna().sum() and got["amount equals zero"] == (number == 0).sum()
    assert got["type not interpretable as revenue or cost"] == sum(k.lower() not in ("cost", "revenue") for k in kinds)


def test_issue_rows_of_one_rule(spark, ledger):
    df = spark.createDataFrame(ledger.assign(source_row_id=range(len(ledger))))
    got = [r["source_row_index"] for r in rows(Q.issue_rows(df, "sales_retail", {c: c for c in ledger.columns}, rule_name="unit_price <= 0"))]
    assert sorted(got) == ledger.index[ledger.unit_price <= 0].tolist()


def test_generic_issue_rows(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "a", 1), (2, None, 2)], "source_row_id long, x string, y long")
    out = sorted((r["source_row_index"], r["rule_name"]) for r in rows(Q.generic_issue_rows(df)))
    assert out == [(0, "duplicate row"), (1, "duplicate row"), (2, "row contains missing values")]

"""KPI tables from distinct records equal those from flagged rows, from one evaluation of the source."""

import re

import numpy as np
import pytest

from sparkwright.operators import finance, logistics, manufacturing, retail
from sparkwright.plans import registry

SF = "/root/testdata/sf0.001"


def _table(spark, fields, seed):
    """Rows of few values each, so that many agree; nulls, bad dates and two spellings of a date among them."""
    g = np.random.default_rng(seed)
    pick = {"date": ["2024-01-05", "01/05/2024", "2024-02-01", "unknown", None], "number": ["1", "2.5", "0", "-3", "bad", None], "text": ["A", "B", " ", None]}

    def values(f):
        if "date" in f or f == "timestamp":
            return pick["date"]
        if f in {"quantity", "unit_price", "amount", "budget", "actual", "shipping_cost", "actual_output", "scrap_count", "downtime_minutes", "planned_output", "runtime_minutes"}:
            return pick["number"]
        return ["Revenue", "Expense", "odd"] if f == "type" else pick["text"]
    one = [[values(f)[int(g.integers(0, len(values(f))))] for f in fields] for _ in range(60)]
    rows = [(i, *one[int(g.integers(0, 60)) if i % 3 else 7]) for i in range(400)]
    return spark.createDataFrame(rows, ", ".join(["rid long", *[f"`{f}` string" for f in fields]])), {f: f for f in fields}


@pytest.mark.parametrize("module,fields,tables", [
    (retail, retail.RETAIL_FIELDS, [lambda t: retail.kpis(retail.cleaned_orders(t)), lambda t: retail.monthly_revenue(retail.cleaned_orders(t)),
                                    lambda t: retail.top_products(retail.cleaned_orders(t)), lambda t: retail.rfm_base(retail.cleaned_orders(t))]),
    (manufacturing, manufacturing.FIELDS, [lambda t: manufacturing.kpis(manufacturing.analysis_rows(t))]),
    (logistics, logistics.FIELDS, [lambda t: logistics.kpis(logistics.analysis_rows(t)), lambda t: logistics.carrier_performance(logistics.analysis_rows(t))]),
    (finance, finance.FIELDS, [lambda t: finance.kpis(finance.analysis_rows(t)), lambda t: finance.monthly_summary(finance.analysis_rows(t))]),
])
def test_records_and_rows_agree(spark, module, fields, tables):
    raw, mapping = _table(spark, fields, len(fields))
    by_row, by_record = module.prepare(raw, mapping, ["rid"]), module.records(raw, mapping)
    assert by_row.count() == 400 and by_row.where("is_duplicate_row").count() == 400 - by_record.count()
    assert by_record.agg({"copies": "sum"}).first()[0] == 400
    for table in [*tables, module.issue_summary]:
        assert sorted(map(str, table(by_row).collect())) == sorted(map(str, table(by_record).collect()))


@pytest.mark.parametrize("name,scans", [("mfg_kpis", 1), ("fin_kpis", 2), ("log_kpis", 6), ("retail_kpis", 5), ("retail_monthly_revenue", 5), ("log_carrier_performance", 6)])
def test_every_file_is_scanned_once(spark, name, scans):
    df = registry.queries()[name](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet", final)) <= scans, final

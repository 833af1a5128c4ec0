"""Management-summary plans: text lines built from the template result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwright.operators import logistics as L
from sparkwright.operators import quality as Q
from sparkwright.operators import retail as R
from sparkwright.operators import summary as S
from sparkwright.plans import finance as FP
from sparkwright.plans import generic as GP
from sparkwright.plans import logistics as LP
from sparkwright.plans import manufacturing as MP
from sparkwright.plans import retail as RP
from sparkwright.sources.readers import read_table
from sparkwright.sources.sinks import stage_table


def _retail(s, d):
    # five tables read the records: they are written once
    records = stage_table(RP.records(s, d), "records")
    cleaned = R.cleaned_orders(records)
    segments = R.segment_summary(R.rfm_segments(R.rfm_base(cleaned)))
    return S.retail(R.kpis(cleaned), R.monthly_revenue(cleaned), R.product_performance(cleaned), segments, R.issue_summary(records))


def _logistics(s, d):
    records = LP.records(s, d, staged=True)
    rows = L.analysis_rows(records)
    return S.logistics(L.kpis(rows), L.carrier_performance(rows), L.issue_summary(records))


def _generic(s, d):
    ev = read_table(s, d, "events")
    used = GP.QUERIES["generic_aggregate"](s, d).agg(F.sum("rows").alias("rows_used"))
    return S.generic(Q.score(ev), len(ev.columns), used, ["value"])


QUERIES = {
    "summary_retail": _retail,
    "summary_manufacturing": lambda s, d: S.manufacturing(MP.QUERIES["mfg_kpis"](s, d),
                                                          MP.QUERIES["mfg_machine_performance"](s, d),
                                                          MP.QUERIES["mfg_issue_summary"](s, d)),
    "summary_logistics": _logistics,
    "summary_finance": lambda s, d: S.finance(FP.QUERIES["fin_kpis"](s, d), FP.QUERIES["fin_category_summary"](s, d),
                                              FP.QUERIES["fin_issue_summary"](s, d)),
    "summary_generic": _generic,
}


# ---- Oracle ---------------------------------------------------------------------------

from sparkwright.plans import quality as QP  # noqa: E402


def _num(x: str, d: int) -> str:
    return f"format('{{:,.{d}f}}', ROUND(CAST({x} AS DOUBLE), {d}))"


def _money(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN '-$' ELSE '$' END || {_num(f'abs({x})', 0)})"


def _pct(x: str) -> str:
    return f"format('{{:.1f}}%', ROUND(({x}) * 100, 1))"


def _emit(lines: list[str], sources: str) -> str:
    return (f", l AS (SELECT list_filter([{', '.join(lines)}], lambda x: x IS NOT NULL) AS lines FROM {sources}) "
            "SELECT CAST(i AS INTEGER) AS line_no, lines[i] AS text FROM l, range(1, len(lines) + 1) r(i)")


def _issues(sql: str) -> str:
    return f"ic AS (SELECT COUNT(*) FILTER (WHERE row_count > 0) AS issue_categories FROM ({sql}))"


def _top(name: str, sql: str, key: str, value: str) -> str:
    return f"{name} AS (SELECT {key} AS k, {value} AS v FROM ({sql}) ORDER BY {value} DESC, {key} LIMIT 1)"


_R = RP.ORACLE
RETAIL_SQL = (
    f"WITH k AS ({_R['retail_kpis']}), m AS ({_R['retail_monthly_revenue']}), "
    f"tr AS (SELECT COUNT(*) AS months, arg_min(net_revenue, month) AS first_net, arg_max(net_revenue, month) AS last_net "
    f"FROM m WHERE month IS NOT NULL), "
    + _top("tp", _R["retail_product_performance"], "product_name", "net_revenue") + ", "
    + _top("ts", _R["retail_segment_summary"], "segment", "revenue") + ", "
    + _issues(_R["retail_issue_summary"])
    + _emit([
        "'Management Summary'", "''",
        "'Net revenue is ' || " + _money("k.net_revenue") + " || ' across ' || "
        "CAST(CAST(k.number_of_orders AS BIGINT) AS VARCHAR) || ' valid orders.'",
        "CASE WHEN tr.months < 2 THEN 'Revenue trend cannot be assessed because fewer than two monthly periods are "
        "available.' WHEN tr.first_net = 0 THEN 'Revenue trend improved from a zero baseline in the first available "
        "month.' ELSE 'Net revenue ' || CASE WHEN (tr.last_net - tr.first_net) / abs(tr.first_net) >= 0 "
        "THEN 'increased' ELSE 'decreased' END || ' by ' || "
        + _pct("abs((tr.last_net - tr.first_net) / abs(tr.first_net))")
        + " || ' from the first to the latest available month.' END",
        "CASE WHEN k.share_revenue_top_10_customers >= 0.35 THEN 'The top 10 customers account for ' || "
        + _pct("k.share_revenue_top_10_customers") + " || ' of net revenue, indicating meaningful customer "
        "concentration.' ELSE 'The top 10 customers account for ' || " + _pct("k.share_revenue_top_10_customers")
        + " || ' of net revenue, suggesting revenue is not overly concentrated.' END",
        "CASE WHEN tp.k IS NOT NULL THEN 'The strongest product is ' || tp.k || ' with ' || " + _money("tp.v")
        + " || ' in net revenue.' ELSE 'Product concentration cannot be assessed because no valid product revenue "
        "was available.' END",
        "CASE WHEN ts.k IS NOT NULL THEN 'The largest revenue customer segment is ' || ts.k || ' with ' || "
        + _money("ts.v") + " || ' in net revenue.' ELSE 'Customer segments could not be calculated because "
        "customer-level revenue was unavailable.' END",
        "CASE WHEN ic.issue_categories > 0 THEN 'Data quality review found ' || CAST(ic.issue_categories AS VARCHAR) "
        "|| ' issue categories requiring attention before production reporting.' ELSE 'The current quality checks "
        "did not find major issues.' END",
        "'Return rate is ' || " + _pct("k.return_rate") + " || '; cancelled order rate is ' || "
        + _pct("k.cancelled_order_rate") + " || '.'",
    ], "k CROSS JOIN tr CROSS JOIN ic LEFT JOIN tp ON true LEFT JOIN ts ON true"))

_M = MP.ORACLE
MFG_SQL = (
    f"WITH k AS ({_M['mfg_kpis']}), " + _top("wm", _M["mfg_machine_performance"], "machine_id", "downtime_minutes")
    + ", " + _issues(_M["mfg_issue_summary"])
    + _emit([
        "'Manufacturing Management Summary'", "''",
        "'Total valid output is ' || " + _num("k.total_output", 0) + " || ' units with a scrap rate of ' || "
        + _pct("COALESCE(k.scrap_rate, 0.0)") + " || '.'",
        "'Total downtime is ' || " + _num("k.total_downtime_minutes", 0) + " || ' minutes, averaging ' || "
        + _num("k.average_downtime_per_machine", 1) + " || ' minutes per machine.'",
        "'Production attainment is ' || " + _pct("COALESCE(k.production_attainment, 0.0)")
        + " || ' where planned output is available.'",
        "'Quality rate approximation is ' || " + _pct("COALESCE(k.quality_rate_approximation, 0.0)") + " || '.'",
        "CASE WHEN k.simplified_oee_approximation IS NOT NULL THEN 'Simplified OEE approximation is ' || "
        + _pct("k.simplified_oee_approximation") + " || '; this is not a certified OEE standard.' END",
        "CASE WHEN wm.k IS NOT NULL THEN 'The highest downtime machine is ' || wm.k || ' with ' || "
        + _num("wm.v", 0) + " || ' downtime minutes.' ELSE 'Machine-level downtime cannot be assessed because no "
        "valid machine performance rows were available.' END",
        "CASE WHEN ic.issue_categories > 0 THEN 'Data quality review found ' || CAST(ic.issue_categories AS VARCHAR) "
        "|| ' issue categories requiring attention.' ELSE 'The current quality checks did not find major "
        "manufacturing data issues.' END",
    ], "k CROSS JOIN ic LEFT JOIN wm ON true"))

_L = LP.ORACLE
LOG_SQL = (
    f"WITH k AS ({_L['log_kpis']}), " + _top("bc", _L["log_carrier_performance"], "carrier", "on_time_rate")
    + ", " + _issues(_L["log_issue_summary"])
    + _emit([
        "'Logistics Management Summary'", "''",
        "'The active dataset contains ' || " + _num("k.shipment_count", 0) + " || ' valid shipments.'",
        "'Average lead time is ' || " + _num("k.average_lead_time_days", 1)
        + " || ' days and on-time delivery rate is ' || " + _pct("k.on_time_delivery_rate") + " || '.'",
        "'Delayed shipments total ' || " + _num("k.delayed_shipments", 0) + " || ', with an average delay of ' || "
        + _num("k.average_delay_days", 1) + " || ' days.'",
        "'Total mapped shipping cost is ' || " + _money("k.total_shipping_cost") + " || '.'",
        "CASE WHEN bc.k IS NOT NULL THEN 'The strongest carrier by on-time rate is ' || bc.k || ' at ' || "
        + _pct("bc.v") + " || '.' ELSE 'Carrier performance cannot be assessed because no usable carrier values "
        "were available.' END",
        "CASE WHEN ic.issue_categories > 0 THEN 'Data quality review found ' || CAST(ic.issue_categories AS VARCHAR) "
        "|| ' logistics issue categories requiring attention.' ELSE 'The current quality checks did not find major "
        "logistics data issues.' END",
    ], "k CROSS JOIN ic LEFT JOIN bc ON true"))

_F = FP.ORACLE
FIN_SQL = (
    f"WITH k AS ({_F['fin_kpis']}), " + _top("tc", _F["fin_category_summary"], "category", "amount")
    + ", " + _issues(_F["fin_issue_summary"])
    + _emit([
        "'Finance Management Summary'", "''",
        "'Total revenue is ' || " + _money("k.total_revenue") + " || ' and total cost is ' || "
        + _money("k.total_cost") + " || '.'",
        "'Net result is ' || " + _money("k.net_result") + " || ' with a margin of ' || " + _pct("k.margin") + " || '.'",
        "'The dataset includes ' || " + _num("k.transaction_count", 0) + " || ' valid finance transactions.'",
        "'Budget variance is ' || " + _money("k.budget_variance")
        + " || ' where budget and actual fields are available.'",
        "CASE WHEN tc.k IS NOT NULL THEN 'The largest mapped category is ' || tc.k || ' with ' || " + _money("tc.v")
        + " || '.' ELSE 'Category-level performance cannot be assessed because no valid categories were "
        "available.' END",
        "CASE WHEN ic.issue_categories > 0 THEN 'Data quality review found ' || CAST(ic.issue_categories AS VARCHAR) "
        "|| ' finance issue categories requiring attention.' ELSE 'The current quality checks did not find major "
        "finance data issues.' END",
    ], "k CROSS JOIN ic LEFT JOIN tc ON true"))

GEN_SQL = (
    f"WITH s AS ({QP.ORACLE['quality_score_generic']}), u AS (SELECT SUM(\"rows\") AS rows_used FROM "
    f"({GP.ORACLE['generic_aggregate']}))"
    + _emit([
        "'Generic Data Summary'", "''",
        "'The active dataset has ' || " + _num("s.row_count", 0) + " || ' rows and ' || " + _num("6", 0)
        + " || ' columns.'",
        "'Data quality score is ' || format('{:.1f}', ROUND(s.overall_score, 1)) || '/100.'",
        "'Missing values total ' || " + _num("s.missing_cells", 0) + " || ' cells and duplicate rows total ' || "
        + _num("s.duplicate_rows", 0) + " || '.'",
        "'The latest generic analytics result used ' || " + _num("u.rows_used", 0) + " || ' rows and measures: value.'",
        "''", "'Recommended next actions:'",
        "'- Review high-missing columns in Data Profile or Data Quality.'",
        "'- Use Data Preparation for logged cleaning steps.'", "'- Use Generic Analytics for exploratory cuts.'",
        "'- Map a domain template only when the dataset has clear business fields.'",
    ], "s CROSS JOIN u"))

ORACLE = {
    "summary_retail": RETAIL_SQL,
    "summary_manufacturing": MFG_SQL,
    "summary_logistics": LOG_SQL,
    "summary_finance": FIN_SQL,
    "summary_generic": GEN_SQL,
}

"""Logistics template plans (lineitem x orders as shipments), with DuckDB oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from sparkwright.operators import controls as C
from sparkwright.operators import logistics as L
from sparkwright.plans.manufacturing import issue_sql
from sparkwright.sources.fixtures import LOGISTICS_MAPPING, LOGISTICS_ROW_KEY, logistics_raw


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.prepare(logistics_raw(spark, sf_dir), LOGISTICS_MAPPING, LOGISTICS_ROW_KEY)


def records(spark: SparkSession, sf_dir: str, staged: bool = False) -> DataFrame:
    """Distinct records: KPI tables need no duplicate flag on every row."""
    return L.records(logistics_raw(spark, sf_dir), LOGISTICS_MAPPING, staged)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.analysis_rows(records(spark, sf_dir))


START, END, CARRIERS = dt.date(1996, 1, 1), dt.date(1997, 12, 31), [f"Supplier#{i:09d}" for i in range(1, 9)]


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis rows inside one range of order dates and one choice of carriers."""
    first = C.filter_date_range(rows(spark, sf_dir), "order_date", START, END)
    return C.filter_values(first, {"carrier": CARRIERS})


QUERIES = {
    "log_prepare": prepared,
    "log_issue_summary": lambda s, d: L.issue_summary(records(s, d)),
    "log_kpis": lambda s, d: L.kpis(rows(s, d)),
    "log_shipments_over_time": lambda s, d: L.shipments_over_time(rows(s, d)),
    "log_lead_time_over_time": lambda s, d: L.lead_time_over_time(rows(s, d)),
    "log_status_summary": lambda s, d: L.status_summary(rows(s, d)),
    "log_carrier_performance": lambda s, d: L.carrier_performance(rows(s, d)),
    "log_destination_performance": lambda s, d: L.destination_performance(rows(s, d)),
    "log_delayed_shipments": lambda s, d: L.delayed_shipments(L.analysis_rows(prepared(s, d))),
    "log_controlled_trend": lambda s, d: L.controlled_trend(rows(s, d), "delivery_date", "average_lead_time_days"),
    "log_controlled_trend_chosen": lambda s, d: L.controlled_trend(chosen(s, d), "delivery_date", "average_lead_time_days"),
    "log_carrier_ranking_chosen": lambda s, d: L.ranking(chosen(s, d), "carrier", "shipment_count", 10),
    "log_carrier_ranking": lambda s, d: L.ranking(rows(s, d), "carrier", "shipment_count", 10),
    "log_destination_ranking": lambda s, d: L.ranking(rows(s, d), "destination", "delayed_shipments", 10),
}

PREPARED = """
log_raw AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_linenumber, l.l_suppkey,
    CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS tracking_id,
    o.o_orderdate AS order_date,
    CASE WHEN NOT (l.l_returnflag = 'N' AND l.l_linestatus = 'O') THEN l.l_shipdate END AS delivered_at,
    o.o_orderdate + INTERVAL 60 DAY AS promised_date,
    s.s_name AS courier, sn.n_name AS warehouse, cn.n_name AS ship_to,
    l.l_extendedprice * l.l_tax AS freight_cost,
    CASE WHEN l.l_returnflag = 'N' AND l.l_linestatus = 'O' THEN 'Open' ELSE 'Delivered' END AS shipment_status
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation sn ON s.s_nationkey = sn.n_nationkey
  LEFT JOIN nation cn ON c.c_nationkey = cn.n_nationkey
),
log_typed AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey,
    NULLIF(TRIM(tracking_id), '') AS shipment_id, NULLIF(TRIM(courier), '') AS carrier,
    NULLIF(TRIM(warehouse), '') AS origin, NULLIF(TRIM(ship_to), '') AS destination,
    NULLIF(TRIM(shipment_status), '') AS delivery_status,
    CAST(order_date AS VARCHAR) AS original_order_date, CAST(delivered_at AS VARCHAR) AS original_delivery_date,
    CAST(promised_date AS VARCHAR) AS original_planned_delivery_date,
    CAST(order_date AS TIMESTAMP) AS order_date, CAST(delivered_at AS TIMESTAMP) AS delivery_date,
    CAST(promised_date AS TIMESTAMP) AS planned_delivery_date,
    CAST(freight_cost AS DOUBLE) AS shipping_cost
  FROM log_raw
),
log_dup AS (
  SELECT *, row_number() OVER (PARTITION BY shipment_id, order_date, delivery_date, planned_delivery_date, carrier,
      origin, destination, shipping_cost, delivery_status ORDER BY l_orderkey, l_partkey, l_linenumber, l_suppkey) > 1
      AS is_duplicate_row
  FROM log_typed
),
log_p98 AS (SELECT quantile_cont(shipping_cost, 0.98) AS p98 FROM log_typed WHERE shipping_cost IS NOT NULL),
log_prepared AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, shipment_id, order_date, delivery_date, planned_delivery_date,
    carrier, origin, destination, shipping_cost, delivery_status,
    original_order_date, original_delivery_date, original_planned_delivery_date, is_duplicate_row,
    carrier IS NULL AS is_missing_carrier,
    delivery_date IS NULL AS is_missing_delivery_date,
    (original_order_date IS NOT NULL AND order_date IS NULL) AS is_invalid_order_date,
    (original_planned_delivery_date IS NOT NULL AND planned_delivery_date IS NULL)
      AS is_invalid_planned_delivery_date,
    CAST(floor((epoch_us(delivery_date) - epoch_us(order_date)) / 86400000000.0) AS BIGINT) AS lead_time_days,
    CAST(floor((epoch_us(delivery_date) - epoch_us(planned_delivery_date)) / 86400000000.0) AS BIGINT)
      AS delay_days,
    COALESCE(floor((epoch_us(delivery_date) - epoch_us(planned_delivery_date)) / 86400000000.0) <= 0, false)
      AS is_on_time,
    COALESCE(shipping_cost > p98, false) AS is_high_shipping_cost,
    (shipment_id IS NOT NULL AND order_date IS NOT NULL AND delivery_date IS NOT NULL
      AND planned_delivery_date IS NOT NULL AND NOT is_duplicate_row) AS is_analysis_valid
  FROM log_dup CROSS JOIN log_p98
),
log_rows AS (SELECT * FROM log_prepared WHERE is_analysis_valid)"""

COST = "CAST(shipping_cost AS DECIMAL(38,6))"
ISSUES = [
    ("Duplicate rows", "is_duplicate_row", "Medium", "Duplicate shipments are excluded from KPI calculations."),
    ("Missing carrier", "is_missing_carrier", "Low", "Rows remain in core KPIs but are not useful for carrier cuts."),
    ("Missing delivery dates", "is_missing_delivery_date", "High",
     "Rows are excluded from lead-time and on-time metrics."),
    ("Order date parsing issues", "is_invalid_order_date", "High",
     "Rows are excluded from time-based shipment analytics."),
    ("Planned delivery date parsing issues", "is_invalid_planned_delivery_date", "High",
     "Rows are excluded from delay metrics."),
    ("High shipping cost outliers", "is_high_shipping_cost", "Business review",
     "Rows are retained but should be reviewed."),
]


def _ranking(key: str, measure: str) -> str:
    return "WITH " + PREPARED + f"""
      SELECT {key}, COUNT(DISTINCT shipment_id) AS shipment_count,
        COALESCE(ROUND(AVG(lead_time_days), 4), 0.0) AS average_lead_time_days,
        COUNT(*) FILTER (WHERE delay_days > 0) AS delayed_shipments,
        CAST(ROUND(COALESCE(SUM({COST}), 0), 2) AS DOUBLE) AS total_shipping_cost
      FROM log_rows WHERE {key} IS NOT NULL GROUP BY {key}
      ORDER BY {measure} DESC, {key} LIMIT 10"""


ORACLE = {
    "log_prepare": "WITH " + PREPARED + " SELECT * FROM log_prepared",
    "log_issue_summary": issue_sql(PREPARED, "log_prepared", ISSUES),
    "log_kpis": "WITH " + PREPARED + f""",
      t AS (SELECT COUNT(DISTINCT shipment_id) AS shipments, AVG(lead_time_days) AS lead,
              AVG(CAST(is_on_time AS DOUBLE)) AS on_time, COUNT(*) FILTER (WHERE delay_days > 0) AS delayed,
              AVG(CASE WHEN delay_days > 0 THEN delay_days END) AS delay,
              COALESCE(SUM({COST}), 0) AS cost FROM log_rows)
      SELECT CAST(shipments AS DOUBLE) AS shipment_count,
        COALESCE(ROUND(lead, 2), 0.0) AS average_lead_time_days,
        COALESCE(ROUND(on_time, 4), 0.0) AS on_time_delivery_rate,
        CAST(delayed AS DOUBLE) AS delayed_shipments,
        CASE WHEN delayed > 0 THEN ROUND(delay, 2) ELSE 0.0 END AS average_delay_days,
        CAST(ROUND(cost, 2) AS DOUBLE) AS total_shipping_cost,
        CASE WHEN shipments > 0 THEN ROUND(CAST(cost AS DOUBLE) / shipments, 2) ELSE 0.0 END
          AS average_cost_per_shipment
      FROM t""",
    "log_shipments_over_time": "WITH " + PREPARED + """
      SELECT date_trunc('month', order_date) AS order_month, COUNT(DISTINCT shipment_id) AS shipment_count
      FROM log_rows GROUP BY 1""",
    "log_lead_time_over_time": "WITH " + PREPARED + """
      SELECT date_trunc('month', order_date) AS order_month, ROUND(AVG(lead_time_days), 2) AS average_lead_time_days
      FROM log_rows GROUP BY 1""",
    "log_status_summary": "WITH " + PREPARED + """
      SELECT CASE WHEN is_on_time THEN 'On time' ELSE 'Delayed' END AS delivery_result,
        COUNT(DISTINCT shipment_id) AS shipments FROM log_rows GROUP BY 1""",
    "log_carrier_performance": "WITH " + PREPARED + f"""
      SELECT carrier, COUNT(DISTINCT shipment_id) AS shipment_count,
        ROUND(AVG(lead_time_days), 4) AS average_lead_time_days,
        COALESCE(ROUND(AVG(CASE WHEN delay_days > 0 THEN delay_days END), 4), 0.0) AS average_delay_days,
        ROUND(AVG(CAST(is_on_time AS DOUBLE)), 4) AS on_time_rate,
        CAST(ROUND(COALESCE(SUM({COST}), 0), 4) AS DOUBLE) AS total_shipping_cost
      FROM log_rows WHERE carrier IS NOT NULL GROUP BY carrier""",
    "log_destination_performance": "WITH " + PREPARED + """
      SELECT destination, COUNT(DISTINCT shipment_id) AS shipment_count,
        COUNT(*) FILTER (WHERE delay_days > 0) AS delayed_shipments,
        COALESCE(ROUND(AVG(CASE WHEN delay_days > 0 THEN delay_days END), 2), 0.0) AS average_delay_days
      FROM log_rows WHERE destination IS NOT NULL GROUP BY destination""",
    "log_delayed_shipments": "WITH " + PREPARED + " SELECT * FROM log_rows WHERE delay_days > 0",
    "log_controlled_trend": "WITH " + PREPARED + """
      SELECT date_trunc('month', delivery_date) AS period, COALESCE(ROUND(AVG(lead_time_days), 4), 0.0) AS value
      FROM log_rows GROUP BY 1""",
    "log_carrier_ranking": _ranking("carrier", "shipment_count"),
    "log_destination_ranking": _ranking("destination", "delayed_shipments"),
}

CHOSEN = """,
log_chosen AS (SELECT * FROM log_rows WHERE order_date >= TIMESTAMP '1996-01-01' AND order_date < TIMESTAMP '1998-01-01'
  AND carrier IN (""" + ", ".join(f"'{x}'" for x in CARRIERS) + "))"
for _name in ("log_controlled_trend", "log_carrier_ranking"):
    _rest = ORACLE[_name][len("WITH " + PREPARED):]
    ORACLE[_name + "_chosen"] = "WITH " + PREPARED + CHOSEN + _rest.replace("log_rows", "log_chosen")

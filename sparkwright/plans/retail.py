"""Retail template plans over the star-schema tables, with their DuckDB oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from sparkwright.operators import retail as R
from sparkwright.sources.fixtures import RETAIL_MAPPING, RETAIL_ROW_KEY, retail_raw


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.prepare(retail_raw(spark, sf_dir), RETAIL_MAPPING, RETAIL_ROW_KEY)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct records: KPI tables need no duplicate flag on every row."""
    return R.records(retail_raw(spark, sf_dir), RETAIL_MAPPING)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cleaned_orders(records(spark, sf_dir))


def cleaned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cleaned_orders(prepared(spark, sf_dir))


def rfm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rfm_base(cleaned(spark, sf_dir))


TREND_START = dt.date(1996, 1, 1)
TREND_END = dt.date(1999, 12, 31)

TREND_COUNTRIES = ["NATION_2", "NATION_6", "NATION_7", "NATION_12", "NATION_20"]


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned rows after one date range and one value filter."""
    return R.controlled_orders(cleaned(spark, sf_dir), TREND_START, TREND_END, {"country": TREND_COUNTRIES})


QUERIES = {
    "retail_prepare": prepared,
    "retail_cleaned_orders": cleaned_rows,
    "retail_issue_summary": lambda s, d: R.issue_summary(records(s, d)),
    "retail_monthly_revenue": lambda s, d: R.monthly_revenue(cleaned(s, d)),
    "retail_product_performance": lambda s, d: R.product_performance(cleaned(s, d)),
    "retail_country_performance": lambda s, d: R.country_performance(cleaned(s, d)),
    "retail_rfm_base": rfm_base,
    "retail_rfm_segments": lambda s, d: R.rfm_segments(rfm_base(s, d)),
    "retail_segment_summary": lambda s, d: R.segment_summary(R.rfm_segments(rfm_base(s, d))),
    "retail_kpis": lambda s, d: R.kpis(cleaned(s, d)),
    "retail_top_products": lambda s, d: R.top_products(cleaned(s, d), "gross_revenue", 10),
    "retail_top_customers": lambda s, d: R.top_customers(cleaned(s, d), "net_revenue", 10),
    "retail_top_products_controlled": lambda s, d: R.top_products(chosen(s, d), "net_revenue", 10),
    "retail_top_customers_controlled": lambda s, d: R.top_customers(chosen(s, d), "gross_revenue", 10),
    "retail_controlled_trend": lambda s, d: R.controlled_trend(chosen(s, d), "net_revenue"),
    "retail_category_revenue": lambda s, d: R.category_revenue(cleaned(s, d)),
}

# ---- Oracle ---------------------------------------------------------------------------

RAW = """
retail_raw AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_linenumber, l.l_suppkey,
    CAST(l.l_orderkey AS VARCHAR) AS "InvoiceNo",
    CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' AND o.o_orderstatus = 'O' THEN 'unknown'
         WHEN o.o_orderpriority = '1-URGENT' THEN strftime(o.o_orderdate, '%m/%d/%Y')
         ELSE strftime(o.o_orderdate, '%Y-%m-%d') END AS "InvoiceDate",
    CASE WHEN c.c_acctbal >= 0 THEN 'C' || CAST(o.o_custkey AS VARCHAR) END AS "CustomerID",
    p.p_name AS "Description", p.p_type AS "Category",
    CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS "Quantity",
    CASE WHEN p.p_size = 1 THEN CAST(0.0 AS DOUBLE) ELSE p.p_retailprice END AS "UnitPrice",
    n.n_name AS "Country",
    CASE o.o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Open' ELSE 'Cancelled' END AS "Status"
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

PREPARED = RAW + """,
retail_typed AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey,
    NULLIF(TRIM("InvoiceNo"), '') AS order_id,
    NULLIF(TRIM("CustomerID"), '') AS customer_id,
    NULLIF(TRIM("Description"), '') AS product_name,
    NULLIF(TRIM("Country"), '') AS country,
    NULLIF(TRIM("Category"), '') AS product_category,
    NULLIF(TRIM("Status"), '') AS invoice_status,
    "InvoiceDate" AS original_order_date,
    COALESCE(try_strptime(TRIM("InvoiceDate"), '%Y-%m-%d'), try_strptime(TRIM("InvoiceDate"), '%m/%d/%Y'))
      AS order_date,
    CAST("Quantity" AS DOUBLE) AS quantity,
    CAST("UnitPrice" AS DOUBLE) AS unit_price
  FROM retail_raw
),
retail_dup AS (
  SELECT *, row_number() OVER (
      PARTITION BY order_id, order_date, customer_id, product_name, product_category, quantity, unit_price,
                   country, invoice_status
      ORDER BY l_orderkey, l_partkey, l_linenumber, l_suppkey) > 1 AS is_duplicate_row,
    regexp_matches(lower(COALESCE(invoice_status, '')), 'cancel|void|rejected') AS is_cancelled
  FROM retail_typed
),
retail_prepared AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, order_id, order_date, customer_id, product_name, quantity,
    unit_price, country, product_category, invoice_status, original_order_date,
    COALESCE(quantity < 0, false) AS is_return,
    (unit_price IS NULL OR COALESCE(unit_price <= 0, false)) AS is_invalid_price,
    customer_id IS NULL AS is_missing_customer,
    (original_order_date IS NOT NULL AND order_date IS NULL) AS is_invalid_date,
    is_cancelled, is_duplicate_row,
    (order_date IS NOT NULL AND quantity IS NOT NULL AND unit_price IS NOT NULL
      AND COALESCE(quantity > 0 AND unit_price > 0, false) AND NOT is_cancelled AND NOT is_duplicate_row)
      AS is_analysis_valid,
    CASE WHEN COALESCE(quantity > 0 AND unit_price > 0, false) AND order_date IS NOT NULL
         AND NOT is_duplicate_row THEN quantity * unit_price ELSE 0.0 END AS gross_revenue,
    CASE WHEN (order_date IS NOT NULL AND quantity IS NOT NULL AND unit_price IS NOT NULL
      AND COALESCE(quantity > 0 AND unit_price > 0, false) AND NOT is_cancelled AND NOT is_duplicate_row)
      THEN quantity * unit_price ELSE 0.0 END AS net_revenue
  FROM retail_dup
)"""

CLEANED = PREPARED + """,
cleaned_orders AS (
  SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(order_date AS TIMESTAMP) AS order_date,
    CAST(customer_id AS VARCHAR) AS customer_id, CAST(product_name AS VARCHAR) AS product_name,
    COALESCE(CAST(product_category AS VARCHAR), 'Uncategorized') AS product_category,
    CAST(quantity AS DOUBLE) AS quantity, CAST(unit_price AS DOUBLE) AS unit_price,
    COALESCE(CAST(country AS VARCHAR), 'Unknown') AS country,
    COALESCE(CAST(invoice_status AS VARCHAR), 'Unknown') AS invoice_status,
    original_order_date, is_return, is_invalid_price, is_missing_customer, is_invalid_date, is_cancelled,
    is_duplicate_row, is_analysis_valid,
    CAST(gross_revenue AS DOUBLE) AS gross_revenue, CAST(net_revenue AS DOUBLE) AS net_revenue
  FROM retail_prepared
)"""

M = "CAST({} AS DECIMAL(38,6))"

RFM_BASE = CLEANED + """,
as_of AS (SELECT MAX(order_date) + INTERVAL 1 DAY AS as_of_date FROM cleaned_orders WHERE is_analysis_valid),
rfm_base AS (
  SELECT customer_id,
    CAST(date_diff('day', CAST(MAX(order_date) AS DATE), CAST(MAX(as_of_date) AS DATE)) AS BIGINT) AS recency_days,
    COUNT(DISTINCT order_id) AS frequency,
    CAST(ROUND(SUM(CAST(net_revenue AS DECIMAL(38,6))), 2) AS DOUBLE) AS monetary
  FROM cleaned_orders CROSS JOIN as_of
  WHERE is_analysis_valid AND customer_id IS NOT NULL AND TRIM(CAST(customer_id AS VARCHAR)) <> ''
  GROUP BY customer_id
  HAVING CAST(ROUND(SUM(CAST(net_revenue AS DECIMAL(38,6))), 2) AS DOUBLE) > 0
)"""

RFM_SEGMENTS = RFM_BASE + """,
rfm_ranked AS (
  SELECT *, COUNT(*) OVER () AS n,
    (rank() OVER (ORDER BY recency_days) + (COUNT(*) OVER (PARTITION BY recency_days) - 1) / 2.0) AS r_rank,
    (rank() OVER (ORDER BY frequency) + (COUNT(*) OVER (PARTITION BY frequency) - 1) / 2.0) AS f_rank,
    (rank() OVER (ORDER BY monetary) + (COUNT(*) OVER (PARTITION BY monetary) - 1) / 2.0) AS m_rank
  FROM rfm_base
),
rfm_scored AS (
  SELECT customer_id, recency_days, frequency, monetary,
    CAST(LEAST(GREATEST(CEIL((1.0 - CAST(r_rank AS DOUBLE) / n + 1.0 / n) * 5.0), 1), 5) AS INTEGER) AS r_score,
    CAST(LEAST(GREATEST(CEIL(CAST(f_rank AS DOUBLE) / n * 5.0), 1), 5) AS INTEGER) AS f_score,
    CAST(LEAST(GREATEST(CEIL(CAST(m_rank AS DOUBLE) / n * 5.0), 1), 5) AS INTEGER) AS m_score
  FROM rfm_ranked
),
rfm_segments AS (
  SELECT *, CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS rfm_score,
    CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
         WHEN f_score >= 4 AND m_score >= 3 THEN 'Loyal Customers'
         WHEN r_score >= 4 AND f_score >= 2 THEN 'Potential Loyalists'
         WHEN r_score >= 4 AND f_score <= 2 THEN 'New Customers'
         WHEN r_score <= 2 AND f_score >= 3 THEN 'At Risk'
         ELSE 'Low Value' END AS segment
  FROM rfm_scored
)"""

PRODUCT_PERF = CLEANED + """,
product_performance AS (
  SELECT product_name, product_category,
    CAST(ROUND(SUM(CAST(net_revenue AS DECIMAL(38,6))), 2) AS DOUBLE) AS net_revenue,
    CAST(ROUND(SUM(CAST(quantity AS DECIMAL(38,6))), 2) AS DOUBLE) AS quantity_sold,
    COUNT(DISTINCT order_id) AS order_count
  FROM cleaned_orders WHERE is_analysis_valid
  GROUP BY product_name, product_category
  ORDER BY net_revenue DESC, product_name, product_category
  LIMIT 100
)"""

CUSTOMER_ROWS = ("is_analysis_valid AND customer_id IS NOT NULL AND TRIM(CAST(customer_id AS VARCHAR)) <> ''")

CHOSEN = """ AND order_date >= TIMESTAMP '1996-01-01' AND order_date < TIMESTAMP '2000-01-01'
        AND country IN (""" + ", ".join(f"'{c}'" for c in TREND_COUNTRIES) + ")"
PRODUCT_EXTRA = "CAST(ROUND(SUM(CAST(quantity AS DECIMAL(38,6))), 2) AS DOUBLE) AS quantity"
CUSTOMER_EXTRA = "COUNT(DISTINCT order_id) AS order_count"


def _top(key: str, measure: str, extra: str, where: str) -> str:
    return f"""
      SELECT {key}, CAST(ROUND(SUM(CAST({measure} AS DECIMAL(38,6))), 2) AS DOUBLE) AS revenue, {extra}
      FROM cleaned_orders WHERE {key} IS NOT NULL{where} GROUP BY {key} ORDER BY revenue DESC, {key} LIMIT 10"""


ORACLE = {
    "retail_prepare": "WITH " + PREPARED + " SELECT * FROM retail_prepared",
    "retail_cleaned_orders": "WITH " + CLEANED + " SELECT * FROM cleaned_orders",
    "retail_issue_summary": "WITH " + PREPARED + """
      SELECT t.issue, CAST(t.row_count AS BIGINT) AS row_count, t.severity, t.analysis_handling FROM (
        SELECT 'Duplicate rows' AS issue, count(*) FILTER (WHERE is_duplicate_row) AS row_count, 'Medium' AS severity,
          'First occurrence retained; repeated exact rows are excluded from KPI calculations.' AS analysis_handling
        FROM retail_prepared
        UNION ALL SELECT 'Missing customer IDs', count(*) FILTER (WHERE is_missing_customer), 'Medium',
          'Excluded from customer-level analytics, retained for sales totals.' FROM retail_prepared
        UNION ALL SELECT 'Returns / negative quantities', count(*) FILTER (WHERE is_return), 'Business event',
          'Tracked as returns and excluded from net revenue KPIs.' FROM retail_prepared
        UNION ALL SELECT 'Invalid unit prices', count(*) FILTER (WHERE is_invalid_price), 'High',
          'Excluded from revenue calculations.' FROM retail_prepared
        UNION ALL SELECT 'Date parsing issues', count(*) FILTER (WHERE is_invalid_date), 'High',
          'Excluded from time-series analytics until dates are corrected.' FROM retail_prepared
        UNION ALL SELECT 'Cancelled orders', count(*) FILTER (WHERE is_cancelled), 'Business event',
          'Excluded from net revenue KPIs.' FROM retail_prepared) t""",
    "retail_monthly_revenue": "WITH " + CLEANED + """
      SELECT CAST(date_trunc('month', order_date) AS DATE) AS month,
        CAST(ROUND(SUM(CAST(gross_revenue AS DECIMAL(38,6))), 2) AS DOUBLE) AS gross_revenue,
        CAST(ROUND(SUM(CAST(net_revenue AS DECIMAL(38,6))), 2) AS DOUBLE) AS net_revenue,
        COUNT(DISTINCT CASE WHEN is_analysis_valid THEN order_id END) AS order_count,
        CAST(SUM(CASE WHEN is_return AND NOT is_duplicate_row THEN 1 ELSE 0 END) AS BIGINT) AS return_rows,
        COUNT(DISTINCT CASE WHEN is_cancelled AND NOT is_duplicate_row THEN order_id END) AS cancelled_orders
      FROM cleaned_orders WHERE order_date IS NOT NULL GROUP BY 1 ORDER BY 1""",
    "retail_product_performance": "WITH " + PRODUCT_PERF + " SELECT * FROM product_performance",
    "retail_country_performance": "WITH " + CLEANED + """
      SELECT country, CAST(ROUND(SUM(CAST(net_revenue AS DECIMAL(38,6))), 2) AS DOUBLE) AS net_revenue,
        COUNT(DISTINCT order_id) AS order_count, COUNT(DISTINCT customer_id) AS customer_count
      FROM cleaned_orders WHERE is_analysis_valid GROUP BY country""",
    "retail_rfm_base": "WITH " + RFM_BASE + " SELECT * FROM rfm_base",
    "retail_rfm_segments": "WITH " + RFM_SEGMENTS + " SELECT * FROM rfm_segments",
    "retail_segment_summary": "WITH " + RFM_SEGMENTS + """
      SELECT segment, COUNT(DISTINCT customer_id) AS customer_count,
        CAST(ROUND(SUM(CAST(monetary AS DECIMAL(38,6))), 2) AS DOUBLE) AS revenue
      FROM rfm_segments GROUP BY segment""",
    "retail_kpis": "WITH " + RFM_BASE + """,
      t AS (
        SELECT COALESCE(SUM(CAST(gross_revenue AS DECIMAL(38,6))), 0) AS g,
          COALESCE(SUM(CAST(net_revenue AS DECIMAL(38,6))), 0) AS n,
          COUNT(DISTINCT CASE WHEN is_analysis_valid THEN order_id END) AS orders,
          COALESCE(SUM(CASE WHEN is_analysis_valid THEN CAST(quantity AS DECIMAL(38,6)) ELSE 0 END), 0) AS qty,
          SUM(CASE WHEN is_return AND NOT is_duplicate_row THEN 1 ELSE 0 END) AS ret,
          SUM(CASE WHEN NOT is_duplicate_row THEN 1 ELSE 0 END) AS rows_nd,
          COUNT(DISTINCT CASE WHEN is_cancelled AND NOT is_duplicate_row THEN order_id END) AS cancelled,
          COUNT(DISTINCT CASE WHEN NOT is_duplicate_row THEN order_id END) AS orders_nd
        FROM cleaned_orders),
      cu AS (SELECT COUNT(DISTINCT customer_id) AS customers FROM cleaned_orders WHERE """ + CUSTOMER_ROWS + """),
      top10 AS (SELECT COALESCE(SUM(CAST(monetary AS DECIMAL(38,6))), 0) AS top10 FROM
                (SELECT monetary FROM rfm_base ORDER BY monetary DESC, customer_id LIMIT 10))
      SELECT CAST(ROUND(g, 2) AS DOUBLE) AS gross_revenue, CAST(ROUND(n, 2) AS DOUBLE) AS net_revenue,
        CAST(orders AS DOUBLE) AS number_of_orders, CAST(customers AS DOUBLE) AS number_of_customers,
        CAST(CASE WHEN orders > 0 THEN ROUND(n / orders, 2) ELSE 0 END AS DOUBLE) AS average_order_value,
        CAST(ROUND(qty, 2) AS DOUBLE) AS total_quantity_sold,
        CAST(CASE WHEN rows_nd > 0 THEN ROUND(CAST(ret AS DECIMAL(38,10)) / rows_nd, 4) ELSE 0 END AS DOUBLE)
          AS return_rate,
        CAST(CASE WHEN orders_nd > 0 THEN ROUND(CAST(cancelled AS DECIMAL(38,10)) / orders_nd, 4) ELSE 0 END
          AS DOUBLE) AS cancelled_order_rate,
        CAST(CASE WHEN n <> 0 THEN ROUND(CAST(top10 AS DECIMAL(38,10)) / CAST(n AS DECIMAL(38,10)), 4) ELSE 0 END
          AS DOUBLE) AS share_revenue_top_10_customers
      FROM t, cu, top10""",
    "retail_top_products": "WITH " + CLEANED + _top("product_name", "gross_revenue", PRODUCT_EXTRA, ""),
    "retail_top_customers": "WITH " + CLEANED + _top("customer_id", "net_revenue", CUSTOMER_EXTRA, ""),
    "retail_top_products_controlled": "WITH " + CLEANED + _top("product_name", "net_revenue", PRODUCT_EXTRA, CHOSEN),
    "retail_top_customers_controlled": "WITH " + CLEANED + _top("customer_id", "gross_revenue", CUSTOMER_EXTRA, CHOSEN),
    "retail_controlled_trend": "WITH " + CLEANED + """
      SELECT date_trunc('month', order_date) AS period,
        CAST(ROUND(SUM(COALESCE(CAST(net_revenue AS DECIMAL(38,6)), 0)), 2) AS DOUBLE) AS revenue
      FROM cleaned_orders WHERE TRUE""" + CHOSEN + " GROUP BY 1",
    "retail_category_revenue": "WITH " + CLEANED + """
      SELECT product_category, CAST(ROUND(SUM(CAST(net_revenue AS DECIMAL(38,6))), 2) AS DOUBLE) AS net_revenue
      FROM cleaned_orders WHERE is_analysis_valid GROUP BY product_category""",
}

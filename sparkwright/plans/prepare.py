"""Preparation-step plans over the test tables, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import prepare as P
from sparkwright.sources.fixtures import retail_raw
from sparkwright.sources.readers import read_table


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their (partial) labels: unlabeled documents carry nulls."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = read_table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders")


def flagged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text flag in several spellings, some of them no boolean."""
    flag = F.expr("CASE o_custkey % 6 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'n' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' END")
    return orders(spark, sf_dir).select("o_orderkey", flag.alias("flag"))


def _clean_text_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.functions import clean_text
    conv = read_table(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn", clean_text("role").alias("role"), clean_text("text").alias("text"))


def _apply_mapping_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.operators.common import apply_mapping
    from sparkwright.sources.fixtures import RETAIL_MAPPING
    from sparkwright.templates import RETAIL_OPTIONAL, RETAIL_REQUIRED
    mapping = {k: v for k, v in RETAIL_MAPPING.items() if k != "country"}  # an unmapped field becomes null
    return apply_mapping(retail_raw(spark, sf_dir), mapping, RETAIL_REQUIRED + RETAIL_OPTIONAL)


REPLAY_STEPS = [
    P.Step("cast_column", ("UnitPrice", "float")),
    P.Step("filter_rows", ("Quantity", "greater_than", 0)),
    P.Step("fill_missing", ("CustomerID", "fill_text_unknown")),
    P.Step("add_revenue", ("Quantity", "UnitPrice", "line_revenue")),
    P.Step("rename_column", ("InvoiceNo", "invoice")),
    P.Step("drop_columns", (["Category", "l_partkey"],)),
    P.Step("parse_dates", ("InvoiceDate",)),
]

QUERIES = {
    "rename_column": lambda s, d: P.rename_column(orders(s, d), "o_totalprice", " total_price "),
    "drop_columns": lambda s, d: P.drop_columns(orders(s, d), ["o_orderpriority", "o_orderstatus"]),
    "cast_integer": lambda s, d: P.cast_column(orders(s, d), "o_totalprice", "integer"),
    "cast_string": lambda s, d: P.cast_column(read_table(s, d, "customer"), "c_acctbal", "string"),
    "cast_float": lambda s, d: P.cast_column(retail_raw(s, d), "InvoiceNo", "float"),
    "to_boolean": lambda s, d: P.to_boolean(flagged_orders(s, d), "flag"),
    "parse_dates": lambda s, d: P.parse_dates(retail_raw(s, d), "InvoiceDate"),
    # every column of every row, each row standing twice
    "drop_duplicates": lambda s, d: P.drop_duplicates(read_table(s, d, "lineitem").unionAll(read_table(s, d, "lineitem"))),
    "fill_zero": lambda s, d: P.fill_zero(doc_labels(s, d), "quality"),
    "fill_median": lambda s, d: P.fill_median(doc_labels(s, d), "toxic"),
    "fill_unknown": lambda s, d: P.fill_unknown(doc_labels(s, d), "quality"),
    "drop_missing_rows": lambda s, d: P.drop_missing_rows(doc_labels(s, d), "quality"),
    "filter_equals": lambda s, d: P.filter_rows(orders(s, d), "o_orderstatus", "equals", "F"),
    "filter_not_equals": lambda s, d: P.filter_rows(orders(s, d), "o_custkey", "not_equals", "1"),
    "filter_not_equals_text": lambda s, d: P.filter_rows(orders(s, d), "o_orderpriority", "not_equals", "5-LOW"),
    "filter_contains": lambda s, d: P.filter_rows(read_table(s, d, "part"), "p_name", "contains", "BLUE"),
    "filter_compare": lambda s, d: P.filter_rows(orders(s, d), "o_totalprice", "greater_or_equal", "300000"),
    "add_revenue": lambda s, d: P.add_revenue(retail_raw(s, d), "Quantity", "UnitPrice", " "),
    "replay_steps": lambda s, d: P.replay(retail_raw(s, d), REPLAY_STEPS),
    "normalize_blanks": lambda s, d: __import__("sparkwright.sources.readers", fromlist=["x"]).normalize_blanks(
        read_table(s, d, "conversations")),
    "validate_table": lambda s, d: __import__("sparkwright.sources.readers", fromlist=["x"]).validate_table(
        read_table(s, d, "labels")),
    "preview": lambda s, d: retail_raw(s, d).orderBy("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey").limit(30),
    "clean_text": _clean_text_plan,
    "apply_mapping": _apply_mapping_plan,
}

from sparkwright.plans.retail import RAW as RETAIL_RAW  # noqa: E402

DOC_LABELS = """doc_labels AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
PARSE = ("COALESCE(try_strptime(TRIM({0}), '%Y-%m-%d'), try_strptime(TRIM({0}), '%m/%d/%Y'))")

ORACLE = {
    "rename_column": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS total_price, o_orderdate,
        o_orderpriority FROM orders""",
    "drop_columns": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders",
    "cast_integer": """SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round_even(o_totalprice, 0) AS BIGINT)
        AS o_totalprice, o_orderdate, o_orderpriority FROM orders""",
    "cast_string": """SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment
        FROM customer""",
    "cast_float": "WITH " + RETAIL_RAW + """ SELECT * REPLACE (TRY_CAST("InvoiceNo" AS DOUBLE) AS "InvoiceNo")
        FROM retail_raw""",
    "to_boolean": """SELECT o_orderkey, CASE WHEN lower(trim(flag)) IN ('true', 't', 'yes', 'y', '1') THEN true
        WHEN lower(trim(flag)) IN ('false', 'f', 'no', 'n', '0') THEN false END AS flag FROM (
        SELECT o_orderkey, CASE CAST(o_custkey % 6 AS INTEGER) WHEN 0 THEN ' Yes ' WHEN 1 THEN 'n' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0'
          WHEN 4 THEN 'maybe' END AS flag FROM orders)""",
    "parse_dates": "WITH " + RETAIL_RAW + " SELECT * REPLACE (" + PARSE.format('"InvoiceDate"') +
    ' AS "InvoiceDate") FROM retail_raw',
    "drop_duplicates": "SELECT DISTINCT * FROM lineitem",
    "fill_zero": "WITH " + DOC_LABELS + """ SELECT doc_id, lang, source, n_chars,
        COALESCE(CAST(quality AS DOUBLE), 0.0) AS quality, toxic FROM doc_labels""",
    "fill_median": "WITH " + DOC_LABELS + """ SELECT doc_id, lang, source, n_chars, quality,
        COALESCE(CAST(toxic AS DOUBLE), (SELECT quantile_cont(CAST(toxic AS DOUBLE), 0.5) FROM doc_labels)) AS toxic
        FROM doc_labels""",
    "fill_unknown": "WITH " + DOC_LABELS + """ SELECT doc_id, lang, source, n_chars,
        COALESCE(CAST(quality AS VARCHAR), 'Unknown') AS quality, toxic FROM doc_labels""",
    "drop_missing_rows": "WITH " + DOC_LABELS + " SELECT * FROM doc_labels WHERE quality IS NOT NULL",
    "filter_equals": "SELECT * FROM orders WHERE o_orderstatus = 'F'",
    "filter_not_equals": "SELECT * FROM orders WHERE o_custkey <> 1",
    "filter_not_equals_text": "SELECT * FROM orders WHERE o_orderpriority <> '5-LOW'",
    "filter_contains": "SELECT * FROM part WHERE contains(lower(p_name), 'blue')",
    "filter_compare": "SELECT * FROM orders WHERE o_totalprice >= 300000",
    "add_revenue": "WITH " + RETAIL_RAW + ' SELECT *, "Quantity" * "UnitPrice" AS revenue FROM retail_raw',
    "replay_steps": "WITH " + RETAIL_RAW + """
      SELECT l_orderkey, l_linenumber, l_suppkey, "InvoiceNo" AS invoice, """ + PARSE.format('"InvoiceDate"') + """ AS "InvoiceDate",
        COALESCE("CustomerID", 'Unknown') AS "CustomerID", "Description", "Quantity", "UnitPrice", "Country", "Status",
        "Quantity" * "UnitPrice" AS line_revenue
      FROM retail_raw WHERE "Quantity" > 0""",
}


ORACLE["normalize_blanks"] = """SELECT conv_id, turn,
    CASE WHEN regexp_matches(role, '^\\s*$') THEN NULL ELSE role END AS role,
    CASE WHEN regexp_matches(text, '^\\s*$') THEN NULL ELSE text END AS text FROM conversations"""
ORACLE["validate_table"] = "SELECT * FROM labels"
ORACLE["preview"] = ("WITH " + RETAIL_RAW + " SELECT * FROM retail_raw ORDER BY l_orderkey, l_partkey, l_linenumber, "
                     "l_suppkey LIMIT 30")
ORACLE["clean_text"] = """SELECT conv_id, turn,
    NULLIF(trim(role, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), '') AS role,
    NULLIF(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), '') AS text FROM conversations"""
ORACLE["apply_mapping"] = "WITH " + RETAIL_RAW + """ SELECT "InvoiceNo" AS order_id, "InvoiceDate" AS order_date,
    "CustomerID" AS customer_id, "Description" AS product_name, "Quantity" AS quantity, "UnitPrice" AS unit_price,
    CAST(NULL AS VARCHAR) AS country, "Category" AS product_category, "Status" AS invoice_status FROM retail_raw"""

"""Adapters from the star-schema test tables to the four template shapes.

Each adapter returns a raw, source-shaped table (business-style column names, text
dates, planted problems) plus the mapping a user would give for it. Problems are planted
from the data itself (negative balances, tiny parts, open orders...), never by sampling,
so the same rows are dirty in Spark and in the SQL oracle, at every scale.

Joins are left to Catalyst/AQE except the 25-row ``nation`` table, which is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.sources.readers import read_table

# Row identity of each raw table (natural keys; unique in the test tables).
LINE_KEY = ["l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"]
RETAIL_ROW_KEY = LINE_KEY
MANUFACTURING_ROW_KEY = LINE_KEY
LOGISTICS_ROW_KEY = LINE_KEY
FINANCE_ROW_KEY = ["o_orderkey"]

RETAIL_MAPPING = {
    "order_id": "InvoiceNo",
    "order_date": "InvoiceDate",
    "customer_id": "CustomerID",
    "product_name": "Description",
    "quantity": "Quantity",
    "unit_price": "UnitPrice",
    "country": "Country",
    "product_category": "Category",
    "invoice_status": "Status",
}
MANUFACTURING_MAPPING = {
    "timestamp": "event_time",
    "machine_id": "machine",
    "actual_output": "output",
    "scrap_count": "scrap",
    "downtime_minutes": "downtime",
    "planned_output": "target_output",
    "runtime_minutes": "runtime",
    "line": "production_line",
    "shift": "shift_name",
    "product": "sku",
    "quality_status": "inspection_status",
}
LOGISTICS_MAPPING = {
    "shipment_id": "tracking_id",
    "order_date": "order_date",
    "delivery_date": "delivered_at",
    "planned_delivery_date": "promised_date",
    "carrier": "courier",
    "origin": "warehouse",
    "destination": "ship_to",
    "shipping_cost": "freight_cost",
    "delivery_status": "shipment_status",
}
FINANCE_MAPPING = {
    "transaction_id": "journal_id",
    "date": "posting_date",
    "amount": "amount",
    "type": "entry_type",
    "category": "expense_category",
    "account": "account_name",
    "cost_center": "business_unit",
    "budget": "budget_amount",
    "actual": "actual_amount",
}
GENERIC_MEASURES = ["value"]
GENERIC_CATEGORY = "event_type"
GENERIC_DATE = "ts"


def _nation(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    # 25 rows by definition of the schema: a proven broadcast bound.
    return F.broadcast(read_table(spark, sf_dir, "nation")
                       .select(F.col("n_nationkey").alias(f"{prefix}_nationkey"),
                               F.col("n_name").alias(f"{prefix}_name")))


def retail_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    df = (li.join(orders, li.l_orderkey == orders.o_orderkey)
          .join(part, li.l_partkey == part.p_partkey)
          .join(cust, orders.o_custkey == cust.c_custkey, "left")
          .join(_nation(spark, sf_dir, "cn"), F.col("c_nationkey") == F.col("cn_nationkey"), "left"))
    invoice_date = (F.when((F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderstatus") == "O"),
                           F.lit("unknown"))
                    .when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "MM/dd/yyyy"))
                    .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return df.select(
        *LINE_KEY,
        F.col("l_orderkey").cast("string").alias("InvoiceNo"),
        invoice_date.alias("InvoiceDate"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("C"), F.col("o_custkey").cast("string")))
        .alias("CustomerID"),
        F.col("p_name").alias("Description"),
        F.col("p_type").alias("Category"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
        .alias("Quantity"),
        F.when(F.col("p_size") == 1, F.lit(0.0)).otherwise(F.col("p_retailprice")).alias("UnitPrice"),
        F.col("cn_name").alias("Country"),
        F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Open")
        .otherwise("Cancelled").alias("Status"),
    )


def manufacturing_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        *LINE_KEY,
        F.col("l_shipdate").alias("event_time"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("M"), F.col("l_suppkey").cast("string"))).alias("machine"),
        F.col("l_quantity").alias("output"),
        (F.col("l_quantity") * F.col("l_discount") * F.lit(2.0)).alias("scrap"),
        (F.col("l_linenumber") * F.lit(5)).alias("downtime"),
        (F.col("l_quantity") * (F.lit(1.0) + F.col("l_tax"))).alias("target_output"),
        F.lit(480).alias("runtime"),
        F.concat(F.lit("Line "), F.col("l_linestatus")).alias("production_line"),
        F.when(F.col("l_returnflag") == "A", "Day").when(F.col("l_returnflag") == "R", "Night")
        .alias("shift_name"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("sku"),
        F.when(F.col("l_discount") >= 0.09, "Review").otherwise("Pass").alias("inspection_status"),
    )


def logistics_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    df = (li.join(orders, li.l_orderkey == orders.o_orderkey)
          .join(supp, li.l_suppkey == supp.s_suppkey, "left")
          .join(cust, orders.o_custkey == cust.c_custkey, "left")
          .join(_nation(spark, sf_dir, "sn"), F.col("s_nationkey") == F.col("sn_nationkey"), "left")
          .join(_nation(spark, sf_dir, "cn"), F.col("c_nationkey") == F.col("cn_nationkey"), "left"))
    open_line = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")
    return df.select(
        *LINE_KEY,
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
        .alias("tracking_id"),
        F.col("o_orderdate").alias("order_date"),
        F.when(~open_line, F.col("l_shipdate")).alias("delivered_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("promised_date"),
        F.col("s_name").alias("courier"),
        F.col("sn_name").alias("warehouse"),
        F.col("cn_name").alias("ship_to"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_cost"),
        F.when(open_line, "Open").otherwise("Delivered").alias("shipment_status"),
    )


def finance_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    df = orders.join(cust, orders.o_custkey == cust.c_custkey, "left")
    return df.select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("journal_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("posting_date"),
        F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "Revenue").when(F.col("o_orderstatus") == "O", "Expense")
        .otherwise("unknown").alias("entry_type"),
        F.col("o_orderpriority").alias("expense_category"),
        F.col("c_name").alias("account_name"),
        F.col("c_mktsegment").alias("business_unit"),
        (F.col("o_totalprice") * F.lit(0.9)).alias("budget_amount"),
        F.col("o_totalprice").alias("actual_amount"),
    )


def generic_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")

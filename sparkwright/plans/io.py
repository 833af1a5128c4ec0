"""Source and sink plans: CSV/JSON round trips, nested records, bundles, packs, KPI long
form, project save/restore and named SQL, with DuckDB oracles.

Round trips write the given tables (or results derived from them) into a fresh folder
under the session's checkpoint location and read them back.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import prepare as P
from sparkwright.plans import finance as FP
from sparkwright.plans import logistics as LP
from sparkwright.plans import manufacturing as MP
from sparkwright.plans import prepare as PP
from sparkwright.plans import retail as RP
from sparkwright.sources import readers as RD
from sparkwright.sources import sinks as SK
from sparkwright.sources.fixtures import RETAIL_MAPPING, retail_raw


def read_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, commas, line breaks and four languages."""
    path = SK.write_table(RD.read_table(spark, sf_dir, "documents"), SK.scratch_dir(spark, "csv"), "csv")
    return RD.read_csv(spark, path)


def read_csv_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = SK.write_table(RD.read_table(spark, sf_dir, "conversations"), SK.scratch_dir(spark, "csv"), "csv")
    return RD.read_csv(spark, path)


def read_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = SK.write_table(RD.read_table(spark, sf_dir, "events"), SK.scratch_dir(spark, "json"), "json")
    return RD.read_json(spark, path)


def widened_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose props have a second key, and a fractional ``k``, in some rows only."""
    wide = F.expr("""CASE WHEN event_id % 7 = 3 THEN concat(rtrim('}', props), '.5, "z": "', event_type, '"}')
                     WHEN event_id % 7 = 5 THEN '{"z": "only"}' ELSE props END""")
    return RD.read_table(spark, sf_dir, "events").withColumn("props", wide)


def flatten_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RD.parse_json_column(widened_events(spark, sf_dir), "props")


def aggregate_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.operators.generic import aggregate
    return aggregate(flatten_events(spark, sf_dir), ["props.k"], "sum", "event_type")


def write_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = SK.scratch_dir(spark, "parquet")
    SK.write_table(RP.QUERIES["retail_monthly_revenue"](spark, sf_dir), folder)
    return SK.read_written(spark, folder)


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"monthly revenue": RP.QUERIES["retail_monthly_revenue"](spark, sf_dir),
              "product performance": RP.QUERIES["retail_product_performance"](spark, sf_dir),
              "country performance": RP.QUERIES["retail_country_performance"](spark, sf_dir)}
    return SK.export_bundle(spark, tables, SK.scratch_dir(spark, "bundle")).drop("path")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SK.pack_tables({"retail_issue_summary": RP.QUERIES["retail_issue_summary"](spark, sf_dir),
                           "log_status_summary": LP.QUERIES["log_status_summary"](spark, sf_dir)})


def kpis_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SK.kpi_long({"retail": RP.QUERIES["retail_kpis"](spark, sf_dir),
                        "manufacturing": MP.QUERIES["mfg_kpis"](spark, sf_dir),
                        "logistics": LP.QUERIES["log_kpis"](spark, sf_dir),
                        "finance": FP.QUERIES["fin_kpis"](spark, sf_dir)})


def save_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = retail_raw(spark, sf_dir)
    out = SK.scratch_dir(spark, "project")
    SK.save_project(spark, out, P.replay(raw, PP.REPLAY_STEPS), PP.REPLAY_STEPS, RETAIL_MAPPING)
    cleaned, steps, mapping = SK.restore_project(spark, out)
    assert [s.describe() for s in steps] == [s.describe() for s in PP.REPLAY_STEPS] and mapping == RETAIL_MAPPING
    return cleaned


#: A statement run through the named-SQL path: repeat customers by country.
NAMED_SQL = """
WITH buyers AS (
  SELECT country, customer_id, COUNT(DISTINCT order_id) AS orders FROM {orders}
  WHERE is_analysis_valid AND customer_id IS NOT NULL GROUP BY country, customer_id)
SELECT country, COUNT(*) AS customers, SUM(CASE WHEN orders > 1 THEN 1 ELSE 0 END) AS repeat_customers, MAX(orders) AS most_orders
FROM buyers GROUP BY country
"""

QUERIES = {
    "read_csv": read_csv_roundtrip,
    "read_csv_conversations": read_csv_conversations,
    "read_json": read_json_roundtrip,
    "flatten_records": flatten_events,
    "generic_aggregate_flattened": aggregate_flattened,
    "write_table": write_roundtrip,
    "export_bundle": bundle,
    "pack_tables": packed,
    "kpi_long": kpis_long,
    "save_restore_project": save_restore,
    "run_named_sql": lambda s, d: SK.run_named_sql(s, NAMED_SQL, orders=RP.cleaned_rows(s, d)),
}


def _kpi_unpivot(name: str, sql: str) -> str:
    return f"SELECT '{name}' AS source, metric, CAST(value AS DOUBLE) AS value FROM (UNPIVOT ({sql}) ON COLUMNS(*) INTO NAME metric VALUE value)"


ORACLE = {
    "read_csv": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN regexp_matches(text, '^\\s*$') THEN NULL ELSE text END AS text,
                   lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents""",
    "read_csv_conversations": """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text FROM conversations""",
    "generic_aggregate_flattened": """
      SELECT event_type, ROUND(SUM(k), 2) AS "props.k", COUNT(*) AS "rows", ROUND(SUM(k), 2) AS value FROM (
        SELECT event_type, CAST(json_extract(props, '$.k') AS DOUBLE) + CASE WHEN event_id % 7 = 3 THEN 0.5 ELSE 0 END AS k
        FROM events WHERE event_id % 7 <> 5) WHERE k IS NOT NULL GROUP BY event_type""",
    "read_json": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, user_id, event_type, value, props
                    FROM events""",
    "flatten_records": """SELECT event_id, ts, user_id, event_type, value,
      CASE WHEN event_id % 7 = 5 THEN NULL ELSE CAST(json_extract(props, '$.k') AS DOUBLE)
        + CASE WHEN event_id % 7 = 3 THEN 0.5 ELSE 0 END END AS "props.k",
      CASE event_id % 7 WHEN 3 THEN event_type WHEN 5 THEN 'only' END AS "props.z" FROM events""",
    "write_table": RP.ORACLE["retail_monthly_revenue"],
    "export_bundle": "WITH " + RP.PRODUCT_PERF + """
      SELECT 'monthly_revenue' AS "table", (SELECT COUNT(DISTINCT date_trunc('month', order_date)) FROM cleaned_orders
        WHERE order_date IS NOT NULL) AS "rows", 6 AS "columns", 'parquet' AS format
      UNION ALL SELECT 'product_performance', (SELECT COUNT(*) FROM product_performance), 5, 'parquet'
      UNION ALL SELECT 'country_performance', (SELECT COUNT(DISTINCT country) FROM cleaned_orders
        WHERE is_analysis_valid), 4, 'parquet'""",
    "pack_tables": "WITH r AS (" + RP.ORACLE["retail_issue_summary"] + "), l AS (" +
    LP.ORACLE["log_status_summary"] + """)
      SELECT 'retail_issue_summary' AS source_table, issue, CAST(row_count AS VARCHAR) AS row_count, severity,
        analysis_handling, NULL AS delivery_result, NULL AS shipments FROM r
      UNION ALL SELECT 'log_status_summary', NULL, NULL, NULL, NULL, delivery_result, CAST(shipments AS VARCHAR) FROM l""",
    "kpi_long": " UNION ALL ".join([
        _kpi_unpivot("retail", RP.ORACLE["retail_kpis"]), _kpi_unpivot("manufacturing", MP.ORACLE["mfg_kpis"]),
        _kpi_unpivot("logistics", LP.ORACLE["log_kpis"]), _kpi_unpivot("finance", FP.ORACLE["fin_kpis"])]),
    "save_restore_project": PP.ORACLE["replay_steps"],
    "run_named_sql": "WITH " + RP.CLEANED + """, buyers AS (
      SELECT country, customer_id, COUNT(DISTINCT order_id) AS orders FROM cleaned_orders
      WHERE is_analysis_valid AND customer_id IS NOT NULL GROUP BY ALL)
      SELECT country, COUNT(*) AS customers, CAST(COUNT(*) FILTER (WHERE orders > 1) AS BIGINT) AS repeat_customers,
        MAX(orders) AS most_orders FROM buyers GROUP BY country""",
}

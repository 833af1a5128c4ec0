"""Generic aggregation and interactive-control plans, with DuckDB oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions import NUMBER_PATTERN
from sparkwright.operators import controls as C
from sparkwright.operators import generic as G
from sparkwright.sources.readers import read_table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def _agg_dated(s, d):
    return G.aggregate(events(s, d), ["value"], "sum", "event_type", "ts")


def _agg_multi(s, d):
    return G.aggregate(events(s, d), ["value", "user_id"], "average", "event_type")


QUERIES = {
    "generic_aggregate": _agg_dated,
    "generic_aggregate_multi": _agg_multi,
    "generic_aggregate_global": lambda s, d: G.aggregate(events(s, d), ["value"], "max"),
    "generic_aggregate_count": lambda s, d: G.aggregate(events(s, d), ["value"], "count", None, "ts"),
    "generic_aggregate_small": lambda s, d: G.aggregate(
        read_table(s, d, "lineitem").withColumn("l_discount", F.col("l_discount") * 1e-6), ["l_discount"], "sum", "l_returnflag"),
    "generic_long": lambda s, d: G.long_form(_agg_multi(s, d), ["event_type"], ["value", "user_id"]),
    "generic_insights": lambda s, d: G.insights(events(s, d), _agg_dated(s, d), ["value"], "sum", "event_type", "ts"),
    "generic_validate_selection": lambda s, d: G.validate_selection(
        events(s, d), ["value", "event_type", "amount"], "event_type", "ts"),
    "top_n": lambda s, d: C.top_n(read_table(s, d, "orders"), "o_totalprice", 20, tiebreak=["o_orderkey"]),
    "monthly_sum": lambda s, d: C.monthly_sum(events(s, d), "ts", "value"),
    "filter_date_range": lambda s, d: C.filter_date_range(read_table(s, d, "orders"), "o_orderdate",
                                                          dt.date(1996, 1, 1), dt.date(1996, 12, 31)),
    "filter_values": lambda s, d: C.filter_values(read_table(s, d, "lineitem"),
                                                  {"l_returnflag": ["R", "A"], "l_linestatus": ["F"], "nope": ["x"]}),
    "filter_options": lambda s, d: C.filter_options(read_table(s, d, "customer"), "c_name"),
}

D = "CAST({} AS DECIMAL(38,12))"
PAT = NUMBER_PATTERN.replace("'", "''")

ORACLE = {
    "generic_aggregate": """
      SELECT date_trunc('month', ts) AS period, COALESCE(CAST(event_type AS VARCHAR), 'Missing') AS event_type,
        COALESCE(CAST(ROUND(SUM(CAST(value AS DECIMAL(38,12))), 2) AS DOUBLE), 0.0) AS value, COUNT(*) AS "rows"
      FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2""",
    "generic_aggregate_small": """
      SELECT l_returnflag, ROUND(SUM(CAST(l_discount * 1e-6 AS DECIMAL(38,12))), 2)::DOUBLE AS l_discount, COUNT(*) AS "rows",
        ROUND(SUM(CAST(l_discount * 1e-6 AS DECIMAL(38,12))), 2)::DOUBLE AS value FROM lineitem GROUP BY 1""",
    "generic_aggregate_multi": """
      SELECT COALESCE(CAST(event_type AS VARCHAR), 'Missing') AS event_type,
        CAST(ROUND(AVG(CAST(value AS DECIMAL(38,12))), 2) AS DOUBLE) AS value,
        CAST(ROUND(AVG(CAST(CAST(user_id AS DOUBLE) AS DECIMAL(38,12))), 2) AS DOUBLE) AS user_id,
        COUNT(*) AS "rows"
      FROM events WHERE value IS NOT NULL OR user_id IS NOT NULL GROUP BY 1""",
    "generic_aggregate_global": """
      SELECT 'max' AS metric, ROUND(MAX(value), 2) AS value, COUNT(*) AS "rows" FROM events WHERE value IS NOT NULL""",
    "generic_aggregate_count": """
      SELECT date_trunc('month', ts) AS period, CAST(COUNT(value) AS DOUBLE) AS value, COUNT(*) AS "rows"
      FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1""",
    "generic_long": """
      WITH a AS (
        SELECT COALESCE(CAST(event_type AS VARCHAR), 'Missing') AS event_type,
          CAST(ROUND(AVG(CAST(value AS DECIMAL(38,12))), 2) AS DOUBLE) AS value,
          CAST(ROUND(AVG(CAST(CAST(user_id AS DOUBLE) AS DECIMAL(38,12))), 2) AS DOUBLE) AS user_id
        FROM events WHERE value IS NOT NULL OR user_id IS NOT NULL GROUP BY 1)
      SELECT event_type, 'value' AS measure, value AS metric_value FROM a
      UNION ALL SELECT event_type, 'user_id' AS measure, user_id AS metric_value FROM a""",
    "generic_insights": """
      WITH a AS (
        SELECT date_trunc('month', ts) AS period, COALESCE(CAST(event_type AS VARCHAR), 'Missing') AS event_type,
          COALESCE(CAST(ROUND(SUM(CAST(value AS DECIMAL(38,12))), 2) AS DOUBLE), 0.0) AS value, COUNT(*) AS "rows"
        FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2),
      f AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE value IS NULL) AS m0,
              COUNT(*) FILTER (WHERE event_type IS NULL) AS m1, COUNT(*) FILTER (WHERE ts IS NULL) AS m2,
              COUNT(*) FILTER (WHERE ts IS NOT NULL) AS n_date FROM events),
      u AS (SELECT COALESCE(SUM("rows"), 0) AS used FROM a),
      top AS (SELECT event_type AS k, value AS v FROM a ORDER BY value DESC, event_type DESC LIMIT 1),
      bot AS (SELECT event_type AS k, value AS v FROM a ORDER BY value ASC, event_type ASC LIMIT 1),
      l AS (SELECT list_filter([
          'Rows used: ' || format('{:,}', used) || '.',
          'Measures selected: value.',
          'Aggregation used: sum.',
          CASE WHEN n_date <> n THEN 'Rows after date parsing filter: ' || format('{:,}', n_date) || '.' END,
          'Missing values in selected columns: value: ' || format('{:,}', m0) || '; event_type: '
            || format('{:,}', m1) || '; ts: ' || format('{:,}', m2) || '.',
          'Highest event_type for value: ' || top.k || ' (' || format('{:,.2f}', top.v) || ').',
          'Lowest event_type for value: ' || bot.k || ' (' || format('{:,.2f}', bot.v) || ').'
        ], lambda x: x IS NOT NULL) AS lines FROM f, u, top, bot)
      SELECT CAST(i AS INTEGER) AS line_no, lines[i] AS text FROM l, range(1, len(lines) + 1) r(i)""",
    "generic_validate_selection": f"""
      WITH c AS (SELECT COUNT(value) AS n0,
                   COUNT(*) FILTER (WHERE regexp_matches(event_type, '{PAT}')) AS n1 FROM events)
      SELECT (n0 > 0 OR n1 > 0) AS valid,
        array_to_string(list_filter([CASE WHEN n0 > 0 THEN 'value' END, CASE WHEN n1 > 0 THEN 'event_type' END],
          lambda x: x IS NOT NULL), ',') AS measures,
        'event_type' AS category_column, 'ts' AS date_column,
        array_to_string(list_filter([
          'Missing measure column(s): amount.',
          CASE WHEN n0 = 0 THEN 'Measure has no numeric values: value.' END,
          CASE WHEN n1 = 0 THEN 'Measure has no numeric values: event_type.' END,
          CASE WHEN NOT (n0 > 0 OR n1 > 0) THEN 'Select at least one numeric measure available in the current dataset.' END
        ], lambda x: x IS NOT NULL), ' ') AS messages
      FROM c""",
    "top_n": "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "monthly_sum": """
      SELECT date_trunc('month', ts) AS period,
        CAST(ROUND(SUM(COALESCE(CAST(value AS DECIMAL(38,12)), 0)), 2) AS DOUBLE) AS value
      FROM events WHERE ts IS NOT NULL GROUP BY 1""",
    "filter_date_range": """
      SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'""",
    "filter_values": "SELECT * FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_linestatus IN ('F')",
    "filter_options": """
      SELECT DISTINCT CAST(c_name AS VARCHAR) AS value FROM customer WHERE c_name IS NOT NULL ORDER BY value""",
}

"""Profiling and dictionary plans over the retail source table, with DuckDB oracles.

The oracle SQL is generated column by column from the source table's schema, using the
same detection rules as the Spark operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions import NUMBER_PATTERN
from sparkwright.operators import dictionary as DICT
from sparkwright.operators import loads as LOADS
from sparkwright.operators import profile as PR
from sparkwright.operators import sketches as SK
from sparkwright.operators.ranking import exact_quantiles, with_row_id
from sparkwright.sources.fixtures import RETAIL_MAPPING, RETAIL_ROW_KEY, retail_raw
from sparkwright.sources.readers import read_table
from sparkwright.sources.sinks import scratch_dir, stage_table


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retail_raw(spark, sf_dir)


def raw_with_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source with a dense ``source_row_id`` in line-key order (computed once, shared)."""
    return with_row_id(retail_raw(spark, sf_dir), RETAIL_ROW_KEY)


def data_dictionary(s, d):
    df = raw_with_id(s, d)
    cols = [c for c in df.columns if c != "source_row_id"]
    return DICT.generate(df, {"sales_retail": RETAIL_MAPPING}, ["source_row_id"], cols)


def _kind_columns(df: DataFrame, kind: str) -> list[str]:
    # Bounded: one row per column of the profiled table.
    return [r["column"] for r in PR.detect_types(df).filter(F.col("kind") == kind).select("column").collect()]


def profile_numeric(s, d):
    df = stage_table(raw(s, d), "raw")  # read for the types, the sums and the quartiles
    return PR.numeric_summary(df, _kind_columns(df, "numeric"))


def profile_categorical(s, d):
    df = raw(s, d)
    cols = _kind_columns(df, "categorical")
    return PR.categorical_summary(PR.value_counts(df, cols), cols)


def box_stats(s, d):
    ev = read_table(s, d, "events")
    long = PR.numeric_long(ev, ["value", "user_id"]).filter(F.col("value").isNotNull())
    q = exact_quantiles(long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["column"])
    mm = long.groupBy("column").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    return mm.join(q, "column").withColumnRenamed("column", "measure")


# Columns of the line table that are profiled from sketches.
SKETCHED = (["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], ["l_returnflag", "l_linestatus"])


def profile_approximate(s, d):
    df = read_table(s, d, "lineitem")
    approximate = SK.profile(SK.merge(SK.sketch(df, *SKETCHED)))
    return SK.beside_exact(df, approximate, [*SKETCHED[0], *SKETCHED[1]])


def fingerprint_loads(s, d):
    """The orders, the same rows in other files and order, and a copy with changed prices."""
    path, again, changed, folder = f"{d}/orders.parquet", *(scratch_dir(s, "loads") for _ in range(3))
    orders = s.read.parquet(path)
    orders.repartition(5, "o_custkey").write.parquet(again)
    orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 1000 == 1, 1.5).otherwise(F.col("o_totalprice"))).write.parquet(changed)
    LOADS.load(s, folder, {"orders": path})
    found, _ = LOADS.load(s, folder, {"orders": path, "orders_again": again, "orders_changed": changed})
    return found


QUERIES = {
    "profile_approximate": profile_approximate,
    "fingerprint_loads": fingerprint_loads,
    "scatter_sample": lambda s, d: PR.scatter_sample(read_table(s, d, "lineitem"), "l_quantity", "l_extendedprice"),
    "detect_types": lambda s, d: PR.detect_types(raw(s, d)),
    "profile_overview": lambda s, d: PR.overview(raw(s, d)),
    "profile_missing": lambda s, d: PR.missing_table(raw(s, d)),
    "profile_unique": lambda s, d: PR.unique_table(PR.value_counts(raw(s, d)), raw(s, d).columns),
    "profile_numeric": profile_numeric,
    "profile_categorical": profile_categorical,
    "data_dictionary": data_dictionary,
    "numeric_histogram": lambda s, d: PR.histogram(read_table(s, d, "lineitem"), "l_extendedprice", 40),
    "box_stats": box_stats,
    "value_frequency": lambda s, d: PR.value_frequency(read_table(s, d, "lineitem"), "l_suppkey", 15),
    "scatter_pairs": lambda s, d: PR.scatter_pairs(read_table(s, d, "lineitem"), "l_quantity", "l_extendedprice"),
    "dataset_size": lambda s, d: PR.dataset_size(raw(s, d)),
    "table_fingerprint": lambda s, d: PR.fingerprint(read_table(s, d, "orders")),
}

# ---- Oracle generation ----------------------------------------------------------------

from sparkwright.plans.retail import RAW  # noqa: E402

COLS = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_linenumber", "int"), ("l_suppkey", "bigint"),
        ("InvoiceNo", "string"),
        ("InvoiceDate", "string"), ("CustomerID", "string"), ("Description", "string"), ("Category", "string"),
        ("Quantity", "double"), ("UnitPrice", "double"), ("Country", "string"), ("Status", "string")]
PAT = NUMBER_PATTERN.replace("'", "''")


def q(c: str) -> str:
    return f'"{c}"'


def num(c: str, t: str) -> str:
    if t == "string":
        return f"CASE WHEN regexp_matches({q(c)}, '{PAT}') THEN TRY_CAST(trim({q(c)}) AS DOUBLE) END"
    return f"CAST({q(c)} AS DOUBLE)"


def date(c: str, t: str) -> str:
    if t == "string":
        return (f"COALESCE(try_strptime(trim({q(c)}), '%Y-%m-%d'), try_strptime(trim({q(c)}), '%m/%d/%Y'))")
    return "CAST(NULL AS TIMESTAMP)"


def text(c: str, t: str) -> str:
    if t == "double":
        return f"CASE WHEN {q(c)} = 0 THEN '0.0' ELSE CAST({q(c)} AS VARCHAR) END"
    return f"CAST({q(c)} AS VARCHAR)"


def _detect_cte() -> str:
    aggs = []
    for c, t in COLS:
        aggs.append(f"COUNT({q(c)}) AS \"nn_{c}\"")
        if t == "string":
            aggs.append(f"COUNT({num(c, t)}) AS \"num_{c}\"")
            aggs.append(f"COUNT({date(c, t)}) AS \"date_{c}\"")
    parts = []
    for i, (c, t) in enumerate(COLS):
        nn = f'"nn_{c}"'
        if t == "string":
            ns = f'CASE WHEN {nn} > 0 THEN CAST("num_{c}" AS DOUBLE) / {nn} ELSE 0.0 END'
            ds = f'CASE WHEN {nn} > 0 THEN CAST("date_{c}" AS DOUBLE) / {nn} ELSE 0.0 END'
            kind = f"CASE WHEN {ns} >= 0.9 THEN 'numeric' WHEN {ds} >= 0.75 THEN 'date' ELSE 'categorical' END"
        else:
            ns, ds, kind = "1.0", "0.0", "'numeric'"
        parts.append(f"SELECT {i} AS pos, '{c}' AS \"column\", '{t}' AS dtype, {nn} AS non_null, "
                     f"CAST({ns} AS DOUBLE) AS numeric_share, CAST({ds} AS DOUBLE) AS date_share, {kind} AS kind FROM w")
    return (RAW + ", w AS (SELECT " + ", ".join(aggs) + " FROM retail_raw), detect AS (" +
            " UNION ALL ".join(parts) + ")")


DETECT = _detect_cte()


def _counts_cte(cols) -> str:
    parts = [f"SELECT '{c}' AS \"column\", {text(c, t)} AS value, "
             f"struct_pack(a := l_orderkey, b := l_partkey, c := l_linenumber, d := l_suppkey) AS o FROM retail_raw" for c, t in cols]
    return ("counts AS (SELECT \"column\", value, COUNT(*) AS n, MIN(o) AS first FROM (" + " UNION ALL ".join(parts) +
            ") WHERE value IS NOT NULL GROUP BY 1, 2)")


NUMERIC_COLS = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_linenumber", "int"), ("l_suppkey", "bigint"),
        ("InvoiceNo", "string"),
                ("Quantity", "double"), ("UnitPrice", "double")]
CATEGORICAL_COLS = [("CustomerID", "string"), ("Description", "string"), ("Category", "string"),
                    ("Country", "string"), ("Status", "string")]


def _numeric_sql() -> str:
    parts = [f"SELECT '{c}' AS \"column\", {num(c, t)} AS v FROM retail_raw" for c, t in NUMERIC_COLS]
    return ("WITH " + RAW + ", l AS (" + " UNION ALL ".join(parts) + ") "
            "SELECT \"column\", ROUND(CAST(COUNT(v) AS DOUBLE), 2) AS \"count\", ROUND(AVG(v), 2) AS mean, "
            "ROUND(stddev_samp(v), 2) AS std, ROUND(MIN(v), 2) AS \"min\", ROUND(quantile_cont(v, 0.25), 2) AS \"25%\", "
            "ROUND(quantile_cont(v, 0.5), 2) AS \"50%\", ROUND(quantile_cont(v, 0.75), 2) AS \"75%\", "
            "ROUND(MAX(v), 2) AS \"max\" FROM l WHERE v IS NOT NULL GROUP BY 1")


def _categorical_sql() -> str:
    return ("WITH " + RAW + ", " + _counts_cte(CATEGORICAL_COLS) + """,
      r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rk FROM counts)
      SELECT "column", CAST(COUNT(*) AS BIGINT) AS unique_values, MAX(CASE WHEN rk = 1 THEN value END) AS most_common,
        CAST(MAX(n) AS BIGINT) AS most_common_count FROM r GROUP BY 1""")


def _dictionary_sql() -> str:
    aggs = ["COUNT(*) AS _rows"]
    for i, (c, t) in enumerate(COLS):
        aggs += [f"COUNT({q(c)}) AS nn{i}", f"COUNT({num(c, t)}) AS num{i}", f"MIN({num(c, t)}) AS min{i}",
                 f"MAX({num(c, t)}) AS max{i}", f"AVG(CAST({num(c, t)} AS DECIMAL(38,6))) AS avg{i}",
                 f"COUNT(*) FILTER (WHERE {num(c, t)} <= 0) AS nonpos{i}"]
        if t == "string":
            aggs += [f"COUNT({date(c, t)}) AS dt{i}", f"MIN({date(c, t)}) AS dmin{i}", f"MAX({date(c, t)}) AS dmax{i}"]
    facts = []
    for i, (c, t) in enumerate(COLS):
        is_num = "true" if t != "string" else f"(nn{i} > 0 AND CAST(num{i} AS DOUBLE) / _rows >= 0.9)"
        if t == "string":
            is_dt = f"(NOT {is_num} AND nn{i} > 0 AND CAST(dt{i} AS DOUBLE) / nn{i} >= 0.8)"
            dmin, dmax, dcount = f"dmin{i}", f"dmax{i}", f"dt{i}"
        else:
            is_dt, dmin, dmax, dcount = "false", "CAST(NULL AS TIMESTAMP)", "CAST(NULL AS TIMESTAMP)", "0"
        facts.append(
            f"SELECT '{c}' AS column_name, _rows, nn{i} AS _nn, _rows - nn{i} AS missing_value_count, "
            f"{is_num} AS _is_num, {is_dt} AS _is_dt, "
            f"CASE WHEN {is_num} THEN ROUND(min{i}, 4) END AS numeric_min, "
            f"CASE WHEN {is_num} THEN ROUND(max{i}, 4) END AS numeric_max, "
            f"CASE WHEN {is_num} THEN CAST(ROUND(avg{i}, 4) AS DOUBLE) END AS numeric_average, "
            f"CASE WHEN {is_dt} THEN strftime({dmin}, '%Y-%m-%d') END AS first_date, "
            f"CASE WHEN {is_dt} THEN strftime({dmax}, '%Y-%m-%d') END AS last_date, "
            f"({is_num} AND nonpos{i} > 0) AS _nonpos, ({is_dt} AND {dcount} < nn{i}) AS _date_issues FROM w")
    maps = []
    for fld, col in RETAIL_MAPPING.items():
        ftype = "required" if fld in ("order_id", "order_date", "customer_id", "product_name", "quantity",
                                      "unit_price") else "optional"
        maps.append(f"('{col}', 'Sales / Retail Analytics: {fld}', 'Sales / Retail Analytics {ftype}', "
                    f"{'true' if ftype == 'required' else 'false'})")
    return ("WITH " + RAW + ", w AS (SELECT " + ", ".join(aggs) + " FROM retail_raw), facts AS (" +
            " UNION ALL ".join(facts) + "), " + _counts_cte(COLS) + """,
      ex AS (SELECT "column", string_agg(value, ', ' ORDER BY rk) AS example_values, MAX(u) AS unique_value_count FROM (
        SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY first, value) AS rk,
          COUNT(*) OVER (PARTITION BY "column") AS u FROM counts) WHERE rk <= 3 GROUP BY 1),
      maps(column_name, mapped_business_field, template_relevance, _has_required) AS (VALUES """ +
            ", ".join(maps) + """),
      j AS (SELECT f.*, COALESCE(ex.unique_value_count, 0) AS uniq, ex.example_values, m.mapped_business_field,
              m.template_relevance, m._has_required,
              ROUND(CAST(f.missing_value_count AS DOUBLE) / GREATEST(f._rows, 1) * 100, 2) AS mp
            FROM facts f LEFT JOIN ex ON ex."column" = f.column_name LEFT JOIN maps m ON m.column_name = f.column_name)
      SELECT column_name,
        CASE WHEN _is_dt THEN 'datetime' WHEN _is_num THEN 'numeric'
             WHEN uniq <= GREATEST(20.0, _rows * 0.05) THEN 'categorical' ELSE 'text' END AS detected_data_type,
        CAST(missing_value_count AS BIGINT) AS missing_value_count, mp AS missing_value_percentage,
        CAST(uniq AS BIGINT) AS unique_value_count, COALESCE(example_values, '') AS example_values,
        numeric_min, numeric_max, numeric_average, first_date, last_date,
        COALESCE(mapped_business_field, '') AS mapped_business_field,
        COALESCE(template_relevance, '') AS template_relevance,
        concat_ws('; ', CASE WHEN mp = 0 THEN 'No missing values' ELSE 'Contains missing values' END,
          CASE WHEN mp >= 30 THEN 'High missing percentage' END,
          CASE WHEN contains(lower(column_name), 'id') OR uniq = _nn THEN 'Potential identifier column' END,
          CASE WHEN COALESCE(_has_required, false) THEN 'Mapped to required template field'
               WHEN mapped_business_field IS NOT NULL THEN 'Mapped to optional template field' END,
          CASE WHEN _nonpos THEN 'Numeric column with zero or negative values' END,
          CASE WHEN _date_issues THEN 'Date column with parsing issues' END) AS quality_notes
      FROM j""")


def _missing_sql() -> str:
    parts = [f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {q(c)} IS NULL) AS missing_count, "
             f"ROUND(CAST(COUNT(*) FILTER (WHERE {q(c)} IS NULL) AS DOUBLE) / GREATEST(COUNT(*), 1) * 100, 2) "
             f"AS missing_percentage FROM retail_raw" for c, _ in COLS]
    return "WITH " + RAW + " " + " UNION ALL ".join(parts)


def _overview_sql() -> str:
    cols = ", ".join(q(c) for c, _ in COLS)
    return ("WITH " + DETECT + f""",
      dup AS (SELECT COALESCE(SUM(n - 1), 0) AS d FROM (SELECT COUNT(*) AS n FROM retail_raw GROUP BY {cols})),
      lists AS (SELECT string_agg("column", ',' ORDER BY pos) FILTER (WHERE kind = 'numeric') AS nc,
                  string_agg("column", ',' ORDER BY pos) FILTER (WHERE kind = 'date') AS dc,
                  string_agg("column", ',' ORDER BY pos) FILTER (WHERE kind = 'categorical') AS cc FROM detect)
      SELECT (SELECT COUNT(*) FROM retail_raw) AS row_count, CAST({len(COLS)} AS BIGINT) AS column_count,
        CAST(d AS BIGINT) AS duplicate_row_count, COALESCE(nc, '') AS detected_numeric_columns,
        COALESCE(dc, '') AS detected_date_columns, COALESCE(cc, '') AS detected_categorical_columns
      FROM dup, lists""")


def _size_sql() -> str:
    width = " + ".join(f"COALESCE(strlen({q(c)}), 0) + 49" if t == "string" else "8" for c, t in COLS)
    return ("WITH " + RAW + f""", t AS (SELECT COUNT(*) AS "rows", COALESCE(SUM({width}), 0) AS bytes FROM retail_raw)
      SELECT "rows", CAST({len(COLS)} AS BIGINT) AS "columns", ROUND(bytes / 1048576.0, 2) AS memory_mb,
        "rows" >= 100000 AS large_rows, {len(COLS)} >= 75 AS wide_table,
        ROUND(bytes / 1048576.0, 2) >= 50 AS large_memory,
        ("rows" >= 100000 OR {len(COLS)} >= 75 OR ROUND(bytes / 1048576.0, 2) >= 50) AS is_large FROM t""")


ORDERS_SCHEMA = ("o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double,"
                 "o_orderdate:timestamp_ntz,o_orderpriority:string")
_O = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

_KEY = ("CAST(('0x' || substr(md5(concat(" + ", ".join(
    f"COALESCE(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in _O) + ")), 1, 15)) AS BIGINT)")


def _loads_sql() -> str:
    def marks(name: str, rows: str, same: str) -> str:
        return (f"SELECT '{name}' AS name, COUNT(*) AS row_count, bit_xor(key) AS hash_xor, CAST(SUM(CAST(key AS DECIMAL(38,0))) AS VARCHAR) AS hash_sum, "
                f"'{ORDERS_SCHEMA}' AS schema, {same} AS same_as FROM (SELECT {_KEY} AS key FROM {rows})")
    changed = "(SELECT * REPLACE (CASE WHEN o_orderkey % 1000 = 1 THEN 1.5 ELSE o_totalprice END AS o_totalprice) FROM orders)"
    return " UNION ALL ".join([marks("orders", "orders", "CAST(NULL AS VARCHAR)"), marks("orders_again", "orders", "'orders'"),
                               marks("orders_changed", changed, "CAST(NULL AS VARCHAR)")])


def _approximate_sql() -> str:
    parts = [f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v, {'true' if numeric else 'false'} AS num FROM lineitem"
             for cols, numeric in zip(SKETCHED, (True, False)) for c in cols]
    return ("WITH c AS (SELECT \"column\", num, v, COUNT(*) AS n FROM (" + " UNION ALL ".join(parts) + ") WHERE v IS NOT NULL GROUP BY ALL) "
            "SELECT \"column\", CAST(SUM(n) AS BIGINT) AS present, COUNT(*) AS unique_values, true AS unique_in_bound, "
            "CASE WHEN num THEN true END AS quantiles_in_bound, CASE WHEN NOT num THEN MAX(n) END AS most_common_count, "
            "CASE WHEN NOT num THEN true END AS common_in_bound FROM c GROUP BY \"column\", num")


ORACLE = {
    "profile_approximate": _approximate_sql(),
    "fingerprint_loads": _loads_sql(),
    "scatter_sample": """
      WITH v AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
      r AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM v),
      b AS (SELECT x, y, CAST(CASE WHEN x1 = x0 THEN 0 ELSE LEAST(floor((x - x0) / ((x1 - x0) / 20.0)), 19) END AS INTEGER) AS bin_x,
              CAST(CASE WHEN y1 = y0 THEN 0 ELSE LEAST(floor((y - y0) / ((y1 - y0) / 20.0)), 19) END AS INTEGER) AS bin_y FROM v, r),
      k AS (SELECT *, COUNT(*) OVER (PARTITION BY bin_x, bin_y) AS bin_rows,
              row_number() OVER (PARTITION BY bin_x, bin_y ORDER BY md5(CAST(x AS VARCHAR) || '|' || CAST(y AS VARCHAR)), x, y) AS rk FROM b)
      SELECT x AS l_quantity, y AS l_extendedprice, bin_x, bin_y, bin_rows FROM k WHERE rk <= 25""",
    "detect_types": "WITH " + DETECT + " SELECT CAST(pos AS INTEGER) AS pos, \"column\", dtype, non_null, numeric_share, date_share, kind FROM detect",
    "profile_overview": _overview_sql(),
    "profile_missing": _missing_sql(),
    "profile_unique": "WITH " + RAW + ", " + _counts_cte(COLS) + ", names AS (SELECT * FROM (VALUES " +
    ", ".join(f"('{c}')" for c, _ in COLS) + """) v("column"))
      SELECT names."column", CAST(COUNT(counts.value) AS BIGINT) AS unique_values
      FROM names LEFT JOIN counts ON counts."column" = names."column" GROUP BY 1""",
    "profile_numeric": _numeric_sql(),
    "profile_categorical": _categorical_sql(),
    "data_dictionary": _dictionary_sql(),
    "numeric_histogram": """
      WITH v AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL),
      r AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM v),
      b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE LEAST(floor((v - lo) / ((hi - lo) / 40.0)), 39) END AS INTEGER)
              AS bin, lo, hi FROM v, r)
      SELECT bin, lo + bin * ((hi - lo) / 40.0) AS lower, lo + (bin + 1) * ((hi - lo) / 40.0) AS upper,
        COUNT(*) AS "count" FROM b GROUP BY bin, lo, hi""",
    "box_stats": """
      WITH l AS (SELECT 'value' AS m, CAST(value AS DOUBLE) AS v FROM events
                 UNION ALL SELECT 'user_id', CAST(user_id AS DOUBLE) FROM events)
      SELECT m AS measure, MIN(v) AS "min", MAX(v) AS "max", quantile_cont(v, 0.25) AS q1,
        quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM l WHERE v IS NOT NULL GROUP BY m""",
    "value_frequency": """
      SELECT CAST(l_suppkey AS VARCHAR) AS value, COUNT(*) AS "count" FROM lineitem WHERE l_suppkey IS NOT NULL
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""",
    "scatter_pairs": """
      SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice
      FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""",
    "dataset_size": _size_sql(),
    "table_fingerprint": """
      WITH k AS (SELECT CAST(('0x' || substr(md5(concat(""" +
    ", ".join(f"COALESCE(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in _O) + """)), 1, 15)) AS BIGINT) AS key FROM orders)
      SELECT COUNT(*) AS row_count, bit_xor(key) AS hash_xor, CAST(SUM(CAST(key AS DECIMAL(38,0))) AS VARCHAR)
        AS hash_sum, '""" + ORDERS_SCHEMA + """' AS schema FROM k""",
}

"""Row ids of the sales lines follow the line key, however the line table is laid out."""

import pytest

from sparkwright.operators.ranking import with_row_id
from sparkwright.plans import profile, quality


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("lines"))
    # keys run down the files, so places in the files run against the key; every part has price 0
    lines = [(k // 3, 1 + k % 3, 7, k % 3 + 1, 1.0 + k, "N") for k in range(30)][::-1]
    made = {"lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"),
            "orders": ([(k, 1, "F", "2-HIGH") for k in range(10)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
            "part": ([(k, f"part {k}", "TYPE", 1, 9.0) for k in (1, 2, 3)], "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double"),
            "customer": ([(1, 1, 5.0)], "c_custkey long, c_nationkey int, c_acctbal double"),
            "nation": ([(1, "NATION_1")], "n_nationkey int, n_name string")}
    for name, (rows, schema) in made.items():
        df = spark.createDataFrame(rows, schema)
        if name == "orders":
            df = df.selectExpr("*", "timestamp_ntz '1997-01-01 00:00:00' + make_dt_interval(cast(o_orderkey as int)) AS o_orderdate")
        df.coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("name", ["quality_issue_rows", "quality_issue_rows_single"])
def test_issue_rows_are_numbered_by_line_key(spark, tables, name):
    found = quality.QUERIES[name](spark, tables).where("rule_name = 'unit_price <= 0'")
    got = [(r["l_orderkey"], r["l_partkey"], r["source_row_index"]) for r in found.collect()]
    assert sorted(got) == [(k // 3, 1 + k % 3, k) for k in range(30)]


def test_generic_issue_rows_are_numbered_by_line_key(spark, tables):
    none_missing = quality.QUERIES["generic_issue_rows"](spark, tables)
    assert none_missing.count() == 0
    orders = spark.read.parquet(f"{tables}/orders.parquet")
    spark.read.parquet(f"{tables}/customer.parquet").selectExpr("c_custkey", "c_nationkey", "-1.0D AS c_acctbal").coalesce(1).write.parquet(f"{tables}/odd/customer.parquet")
    for name in ("lineitem", "part", "nation"):
        spark.read.parquet(f"{tables}/{name}.parquet").coalesce(1).write.parquet(f"{tables}/odd/{name}.parquet")
    orders.coalesce(1).write.parquet(f"{tables}/odd/orders.parquet")
    got = [(r["source_row_index"], r["InvoiceNo"], r["Quantity"]) for r in quality.QUERIES["generic_issue_rows"](spark, f"{tables}/odd").collect()]
    assert sorted(got) == [(k, str(k // 3), 1.0 + k) for k in range(30)]


def test_dictionary_examples_come_in_line_key_order(spark, tables):
    got = {r["column_name"]: r["example_values"] for r in profile.QUERIES["data_dictionary"](spark, tables).collect()}
    assert got["l_orderkey"] == "0, 1, 2" and got["Quantity"] == "1.0, 2.0, 3.0" and got["Description"] == "part 1, part 2, part 3"


def test_ids_are_numbered_without_a_shuffle_of_the_sorted_copy(spark):
    df = with_row_id(spark.range(500).selectExpr("id % 7 AS a", "CASE WHEN id > 3 THEN id END AS b"), ["a", "b"], "rid")
    rows = df.orderBy("rid").collect()
    assert [r["rid"] for r in rows] == list(range(500))
    far = float("inf")
    assert [(r["a"], far if r["b"] is None else r["b"]) for r in rows] == sorted((r["a"], far if r["b"] is None else r["b"]) for r in rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan

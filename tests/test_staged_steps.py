"""Wide rows and joined sources are not shuffled or evaluated more often than needed."""

import re

from sparkwright.operators import common
from sparkwright.plans import registry
from sparkwright.session import DEFAULT_CONF

SF = "/root/testdata/sf0.001"


def _final(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_rows_meet_few_repeated_digests_without_a_shuffle(spark):
    rows = [(i, f"text {i}", None if i % 5 else 1.0) for i in range(300)] + [(300, "text 7", None), (301, "text 7", None)]
    df = spark.createDataFrame(rows, "rid long, t string, v double")
    flagged = common.flag_duplicates(df, ["t", "v"], ["rid"])
    assert sorted(r["rid"] for r in flagged.where("is_duplicate_row").collect()) == [300, 301]
    assert flagged.count() == 302
    plan = _final(flagged)
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan, plan


def test_summaries_and_numeric_profile_join_their_source_once(spark):
    for name in ("summary_retail", "summary_logistics", "profile_numeric"):
        plan = _final(registry.queries()[name](spark, SF))
        assert not re.search(r"Location: InMemoryFileIndex\S* ?\S*sf0\.001/(lineitem|orders)", plan), name


def test_a_task_reads_less_than_the_default_of_spark():
    assert DEFAULT_CONF["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "16m"

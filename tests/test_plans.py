"""Physical plans: what is pushed down, pruned and limited, and what must never appear."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from threadloom.operators import history
from threadloom.plans import catalog


PLANS = {}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plan_of(name, spark):
    """A query's plan; queries that write on the way run once for all tests."""
    if name not in PLANS:
        PLANS[name] = plan(catalog.QUERIES[name](spark, SF))
    return PLANS[name]


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n != "source_regex_select"))
def test_no_cross_joins(name, spark):
    text = plan_of(name, spark)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_columns_are_pruned(spark):
    assert "ReadSchema: struct<user_id:bigint>" in plan(catalog.QUERIES["user_activity_counts"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan(catalog.QUERIES["distinct_users_posts"](spark, SF))


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(role), Not(EqualTo(role,system))" in plan(catalog.QUERIES["conversation_examples"](spark, SF))


def test_limits_reach_below_the_shuffle(spark):
    for name in ("first_h_history", "last_per_key", "first_per_key", "rows_per_post_cap"):
        assert "WindowGroupLimit" in plan(catalog.QUERIES[name](spark, SF))


def test_python_only_where_it_must_be(spark):
    # mails, near-JSON and JSON of any shape, calls from tasks
    python = {"tolerant_json", "nearly_json", "cleaned_objects", "email_rows", "flat_mails", "nested_mails", "quoted_mails", "reply_chains", "mail_parse_stats", "persona_modes"}
    for name in catalog.QUERIES:
        if name not in python:
            assert "Python" not in plan_of(name, spark), name


def test_hot_users_are_ranked_in_parts(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("user_id"), F.col("id"), F.pmod(F.col("id") * 7919, F.lit(5000)).alias("t"))
    one = history.ranked(df, ["t", "id"])
    parts = history.ranked(df, ["t", "id"], spread=F.floor(F.col("t") / 100))
    assert sorted(map(tuple, one.select("id", "rn").collect())) == sorted(map(tuple, parts.select("id", "rn").collect()))

"""Scale properties of the physical plans (what the operators promise in README "Scale")."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tablekit.functions.spec import Condition
from tablekit.operators.chart import chart_aggregate
from tablekit.operators.edit import edit_drop_duplicates
from tablekit.operators.filtering import apply_filters
from tablekit.operators.profile import Profile, pass2
from tablekit.operators.shape import paginate
from tablekit.plans.sqlcell import run_template

SF = "/root/testdata/sf0.001"


def own_queries():
    """Keys of the reference's operators."""
    E.queries()
    from tablekit.acceptance import QUERIES
    return list(QUERIES)


def plan_of(df):
    df.collect()                      # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def tbl(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_keep_first_dedup_limits_before_the_shuffle(spark):
    plan = plan_of(edit_drop_duplicates(tbl(spark, "orders"), ["o_custkey"], [("o_orderdate", False),
                                                                            ("o_orderkey", True)]))
    assert "Partial" in plan and "Final" in plan
    assert plan.rfind("Exchange") < plan.rfind("WindowGroupLimit")   # partial sits below the exchange


def test_in_list_is_a_broadcast_semi_join(spark):
    df = run_template(spark, "SELECT * FROM {{ t | identifier }} WHERE c_custkey IN {{ ks | inclause }}",
                      {"t": "tk_cust", "ks": list(range(0, 3000, 3))}, {"tk_cust": tbl(spark, "customer")})
    plan = plan_of(df)
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan and "Cartesian" not in plan


def test_shallow_page_is_a_per_task_heap(spark):
    plan = plan_of(paginate(tbl(spark, "lineitem"), 3, 10, [("l_orderkey", True), ("l_linenumber", True)]))
    assert "TakeOrderedAndProject" in plan and "Window" not in plan


def test_percentage_uses_a_scalar_subquery_not_a_window(spark):
    plan = plan_of(chart_aggregate(tbl(spark, "orders"), ["o_orderstatus"], "Percentage of COUNT(*)"))
    assert "Subquery" in plan and "Window" not in plan


def test_profile_pass2_is_chunked_with_a_partial_top_limit(spark):
    from tablekit.operators.profile import STATS_CHUNK
    li = tbl(spark, "lineitem")
    p = Profile(li)
    p.min_max()
    df = pass2(li, p.plans, p.stats)
    plan = plan_of(df)
    formatted = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    schemas = re.findall(r"ReadSchema: struct<([^>\n]*)>", formatted)
    assert schemas and all(len(s.split(",")) <= STATS_CHUNK for s in schemas)   # bounded width per scan
    assert "WindowGroupLimit" in plan and "Partial" in plan                    # top values: per-task limit
    assert "Cartesian" not in plan


def test_filters_reach_the_scan(spark):
    df = apply_filters(tbl(spark, "events"), [Condition("ts", "is-on", ("2024-01-02",)),
                                              Condition("user_id", "less-than", ("10.5",))])
    df.collect()
    formatted = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", formatted).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed and "LessThan(user_id,11)" in pushed


@pytest.mark.parametrize("key", sorted(own_queries()))
def test_no_cartesian_products(spark, key):
    plan = plan_of(E.queries()[key](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_long_text_in_a_profile_exchange(spark):
    docs = tbl(spark, "documents")
    p = Profile(docs, ["text", "lang"])
    plan = pass2(docs, p.plans, p.stats)._jdf.queryExecution().executedPlan().toString()
    assert "md5(" in plan


def test_sizes_and_profiles_do_not_sort(spark):
    from tablekit.plans.browse import browse_table
    shown = browse_table(tbl(spark, "lineitem"), {"sortBy": [{"id": "l_shipdate", "type": "asc"}]})
    p = Profile(shown.selected)
    p.min_max()
    plan = plan_of(pass2(p.df, p.plans, p.stats))
    assert "rangepartitioning" not in plan

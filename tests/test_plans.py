"""Plan checks: pushdown, pruning, no Python in native operators, no cross
products, ranked filters become WindowGroupLimit."""

import __spark_entry__ as E
from tests.conftest import SF_SMALL

Q = E.queries()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_pushed_and_columns_pruned(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")     # the list is cut at 100 characters otherwise
    try:
        plan = _plan(Q["flt_compare"](spark, SF_SMALL))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters: ["):]
    pushed = pushed[: pushed.index("]") + 1]
    assert "LessThanOrEqual(l_quantity,5.0)" in pushed and "IsNotNull(l_shipdate)" in pushed
    assert "GreaterThanOrEqual(l_shipdate,1997-01-01" in pushed and "LessThan(l_shipdate,1998-01-01" in pushed
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_shipdate:timestamp_ntz>" in plan


def test_native_queries_have_no_python_and_no_cartesian(spark):
    for qid in ["agg_faulty_by_source", "flt_quality_rules", "agg_share_of_total", "join_cross_scalar",
                "dt_round_hour", "dq_dedup_first", "ml_auc", "ml_cutoff_table", "agg_boxplot_stats"]:
        plan = _plan(Q[qid](spark, SF_SMALL))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, qid
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, qid


def test_ranked_filter_uses_window_group_limit(spark):
    df = Q["win_dense_rank_topk"](spark, SF_SMALL)
    df.collect()
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString() or \
        "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString()


def test_udf_surface_is_arrow_batched(spark):
    plan = _plan(Q["udf_scalar"](spark, SF_SMALL))
    assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan


def test_partition_scan_prunes_directories(spark):
    df = Q["src_partition_scan"](spark, SF_SMALL)
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(yr" in plan and "(yr#" in plan and "mn#" in plan
    assert df.count() == 3 or df.count() <= 3


def test_share_total_is_a_scalar_subquery(spark):
    plan = _plan(Q["agg_share_of_total"](spark, SF_SMALL))
    assert "Subquery" in plan and "CartesianProduct" not in plan

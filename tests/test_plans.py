"""Shapes of physical plans that have to hold at scale."""

import os
import re

import pytest
from tidemark.operators import joins as J
from tidemark.operators import predicates as P
from tidemark.plans import history as H
from workload import base
from workload.base import CUT_NEW, IDS, history_image, history_target

SHUFFLING = ["diff_deletes", "diff_inserts", "diff_updates", "classify_changes", "scd2_apply", "close_versions", "anti_not_in",
             "in_or_in", "null_safe_join", "full_outer_merge", "or_join", "theta_array_join", "as_of_latest", "align_to_schedule",
             "join_version_range", "scalar_subquery", "range_between_join", "eval_pattern_condition", "upsert_by_natural_key",
             "relink_parent", "audit_orphans", "cross_join", "load_relationship"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module", autouse=True)
def entry():
    import __spark_entry__

    return __spark_entry__


@pytest.mark.parametrize("name", SHUFFLING)
def test_no_product_joins(spark, sf, name):
    plan = plan_of(base.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["classify_changes", "scd2_apply", "as_of_latest", "dense_rank", "running_sum", "retry_state"])
def test_windows_are_partitioned(spark, sf, name):
    plan = plan_of(base.QUERIES[name](spark, sf))
    assert "SinglePartition" not in plan


def test_classification_joins_once_without_extra_shuffles(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        target, image = history_target(spark, sf), history_image(spark, sf)
        images = sum(plan_of(df).count("Exchange hashpartitioning") for df in (P.valid_at(target, CUT_NEW), image))
        plan = plan_of(H.classify_changes(target, image, IDS, CUT_NEW))
        assert len(re.findall(r"SortMergeJoin.*FullOuter|ShuffledHashJoin.*FullOuter", plan)) == 1
        assert plan.count("Exchange hashpartitioning") == images
        sorts = sum(plan_of(df).count(" Sort [") for df in (P.valid_at(target, CUT_NEW), image))
        assert plan.count(" Sort [") == sorts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(base.QUERIES["range_between_join"](spark, sf))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    plan = plan_of(base.QUERIES["audit_unique"](spark, sf))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan


def test_group_limits_apply_before_the_shuffle(spark, sf):
    for name in ("top_n_per_group", "row_number_first"):
        plan = plan_of(base.QUERIES[name](spark, sf))
        assert re.search(r"WindowGroupLimit .*Partial", plan), name


def test_groups_are_combined_before_the_shuffle(spark, sf):
    plan = plan_of(base.QUERIES["bool_connective"](spark, sf))
    assert plan.count("HashAggregate") == 2 and "partial_" in plan


def test_nothing_is_broadcast_beyond_the_limit(spark, sf):
    """With broadcasting by size switched off no join of two tables is a broadcast join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        orders = spark.read.parquet(f"{sf}/orders.parquet")
        lines = spark.read.parquet(f"{sf}/lineitem.parquet")
        for df in (
            J.inner(orders, lines, {"o_orderkey": "l_orderkey"}),
            base.QUERIES["scd2_apply"](spark, sf),
            base.QUERIES["upsert_by_natural_key"](spark, sf),
        ):
            assert "BroadcastHashJoin" not in plan_of(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_library_has_no_shortcuts():
    """No local checkpoints, forced broadcasts but of slice sums and hot keys, cross joins, Python UDFs or RDDs."""
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tidemark")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue  # text operators have rules of their own
        for name in files:
            if name.endswith(".py"):
                body = open(os.path.join(folder, name), encoding="utf-8").read()
                for word in ("localCheckpoint", "crossJoin", "pandas_udf", "F.udf", ".rdd", "toPandas"):
                    assert word not in body, (name, word)
                if name not in ("ordered.py", "skew.py"):
                    assert "F.broadcast(" not in body, name


def test_shared_folder_follows_the_session(spark):
    from tidemark.session import shared_folder

    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = shared_folder(spark)
    assert named is None or folder == named
    assert spark.sparkContext.getCheckpointDir() is not None

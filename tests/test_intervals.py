"""Points in intervals by blocks, and reachability by numbers, against plain loops."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import hierarchy as T
from tidemark.operators import intervals as V
from test_hierarchy import frame, kids_of, leaves, random_tree


def test_covers_are_exact_and_small(spark):
    r = random.Random(1)
    pairs = [(a, a + r.choice([0, 1, 2, 3, 17, 1000, 10**6, 10**12, 10**15])) for a in [r.randrange(-(10**7), 10**7) for _ in range(150)]] + [(5, 3), (0, 4**16)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", V.cover(F.col("a"), F.col("b")).alias("c"))
    for row in df.collect():
        blocks = sorted((x["block"] * 4 ** x["level"], (x["block"] + 1) * 4 ** x["level"]) for x in row["c"])
        if row["a"] >= row["b"]:
            assert blocks == []
            continue
        assert blocks[0][0] == row["a"] and blocks[-1][1] == row["b"]
        assert all(x[1] == y[0] for x, y in zip(blocks, blocks[1:]))
        assert len(blocks) <= 6 * (1 + math.log(row["b"] - row["a"], 4))


def test_join_equals_a_loop_with_hot_keys_and_nulls(spark):
    r = random.Random(2)
    points = [(i, r.choice(["hot", "hot", "b", None]), r.choice([None, *range(-50, 300)])) for i in range(400)]
    intervals = [(i, r.choice(["hot", "hot", "b", None]), *r.choice([(None, 5), (7, None), (a := r.randrange(-60, 290), a + r.choice([-1, 0, 1, 5, 400]))])) for i in range(150)]
    p = spark.createDataFrame(points, "i int, k string, at long")
    v = spark.createDataFrame(intervals, "j int, c string, lo long, hi long")
    got = V.join_in_blocks(p, v, {"k": "c"}, F.col("at"), F.col("lo"), F.col("hi"))
    assert got.columns == ["i", "k", "at", "j", "c", "lo", "hi"]
    want = [(i, j) for i, k, at in points for j, c, lo, hi in intervals if k is not None and k == c and None not in (at, lo, hi) and lo <= at < hi]
    assert rows(got, "i", "j") == sorted(want, key=repr)
    assert V.join_in_blocks(p, v.limit(0), {"k": "c"}, F.col("at"), F.col("lo"), F.col("hi")).collect() == []


def test_versions_of_one_key_are_not_tested_in_pairs(spark):
    """A key with 40,000 versions: the join's keys are key, size and block alone, and each row meets one version."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        at = lambda c: (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=c * 7)).alias
        n = 40_000
        versions = spark.range(n).select(F.lit("k").alias("c"), F.col("id").alias("v"), at(F.col("id"))("start_ts"), at(F.col("id") + 1)("end_ts"))
        facts = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("f"), (at(F.col("id"))("x") + F.expr("interval 3 minutes")).alias("at"))
        got = V.join_versions(facts, versions, {"k": "c"}, "at", unit=600)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
        line = next(x for x in plan.splitlines() if "SortMergeJoin" in x)
        assert "__level" in line and "__block" in line
        assert got.agg(F.count("*"), F.count_if(F.col("f") == F.col("v"))).first()[:] == (n, n)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_open_and_empty_versions(spark):
    ts = lambda *x: dt.datetime(*x)
    versions = [("a", 1, ts(2020, 1, 1), ts(9999, 12, 31, 23, 59, 59)), ("a", 2, ts(2020, 1, 5), ts(2020, 1, 5)), ("a", 3, ts(2019, 1, 1), ts(2020, 1, 1, 0, 0, 0, 1))]
    facts = [(1, "a", ts(2020, 1, 1)), (2, "a", ts(2020, 1, 1, 0, 0, 0, 1)), (3, "a", ts(2020, 1, 5)), (4, "a", ts(1960, 1, 1)), (5, "a", ts(9999, 12, 31, 23, 59, 59))]
    got = V.join_versions(spark.createDataFrame(facts, "f int, k string, at timestamp_ntz"),
                          spark.createDataFrame(versions, "c string, v int, start_ts timestamp_ntz, end_ts timestamp_ntz"), {"k": "c"}, "at")
    assert rows(got, "f", "v") == [(1, 1), (1, 3), (2, 1), (3, 1)]


def test_reachability_of_many_starts(spark):
    n = 120
    tree = random_tree(n, 3, True)
    df, kids = frame(spark, tree), kids_of(tree)

    def below(i):
        return [x for c in kids[i] for x in [c, *below(c)]]

    marked = {r["id"]: (r["first"], r["last"]) for r in T.labels(df, "id", "parent_id", "position").collect()}
    assert sorted(f for f, _ in marked.values()) == list(range(1, n + 1))
    assert {(i, j) for i in tree for j in tree if i != j and marked[i][0] <= marked[j][0] <= marked[i][1]} == {(i, j) for i in tree for j in below(i)}
    starts = df.where("id % 3 = 0")
    got = T.descendants_of_each(df, starts, "id", "parent_id", "position")
    assert rows(got, "start", "id") == sorted([(i, j) for i in tree if i % 3 == 0 for j in below(i)], key=repr)

    def after(leaf):
        out, child = set(), leaf
        while tree[child][0] is not None:
            parent = tree[child][0]
            if tree[parent][2] == T.SEQUENCE:
                out |= {x for c in kids[parent] if tree[c][1] > tree[child][1] for x in [c, *below(c)] if not kids[x]}
            child = parent
        return out

    ends = df.where(F.col("kind") == T.ATOM)
    got = T.downstream_of_each(df, ends, "id", "parent_id", "position", "kind")
    assert rows(got, "start", "id") == sorted([(i, j) for i in tree if not kids[i] for j in after(i)], key=repr)
    assert leaves(tree, kids, 0, "first")


def test_estimates_of_size_do_not_grow_with_the_rounds(spark):
    df = spark.range(120).select("id", F.expr("case when id > 0 then (id - 1) div 2 end").alias("parent_id"), F.lit(0).alias("position"))
    got = T.labels(df, "id", "parent_id", "position")
    assert got.count() == 120
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 300


def test_labels_of_keys_that_occur_twice(spark):
    df = spark.createDataFrame([(1, None, 0), (2, 1, 0), (2, 1, 0), (3, 2, 1)], "id long, parent_id long, position int")
    got = T.descendants_of_each(df, df.where("id = 1"), "id", "parent_id", "position").distinct()
    assert rows(got, "start", "id") == [(1, 2), (1, 3)]

"""The sliced forms must equal the windowed ones, whatever the group sizes."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import aggregates as A
from tidemark.operators import joins as J
from tidemark.operators import ordered as O
from tidemark.operators import reshape as R
from tidemark.operators.skew import lookup


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds about a third of the rows, one key is NULL, values repeat and are sometimes NULL."""
    i = F.col("id")
    return spark.range(3000).select(
        i,
        F.when(i % 3 == 0, 0).when(i % 101 == 1, F.lit(None)).otherwise(i % 17).cast("int").alias("k"),
        ((i * 7919) % 503).cast("int").alias("o"),
        F.when(i % 5 == 0, F.lit(None)).otherwise(i % 23).cast("int").alias("v"),
    ).repartition(7).cache()


ORDER = [O.By("o", desc=True), O.By("v", nulls_first=True), O.By("id")]


def sort(order):
    return [o.column() for o in order]


def test_running_sum(skewed):
    got = O.running_sum(skewed, ["k"], ORDER, "v", "s", group_rows=0)
    w = Window.partitionBy("k").orderBy(*sort(ORDER)).rowsBetween(Window.unboundedPreceding, 0)
    assert rows(got, "id", "s") == rows(skewed.withColumn("s", F.sum("v").over(w)), "id", "s")


def test_running_sum_without_keys(skewed):
    got = O.running_sum(skewed, [], ["id"], "id", "s")
    total, want = 0, []
    for i in range(3000):
        total += i
        want.append((i, total))
    assert sorted(tuple(r) for r in got.select("id", "s").collect()) == want


def test_row_number(skewed):
    got = O.row_number(skewed, ["k"], ORDER, "n", group_rows=0)
    w = Window.partitionBy("k").orderBy(*sort(ORDER))
    assert rows(got, "id", "n") == rows(skewed.withColumn("n", F.row_number().over(w).cast("bigint")), "id", "n")


@pytest.mark.parametrize("dense", [False, True])
def test_rank(skewed, dense):
    order = [O.By("v", desc=True)]
    got = O.rank(skewed, ["k"], order, "r", dense=dense, group_rows=0)
    fn = F.dense_rank() if dense else F.rank()
    want = skewed.withColumn("r", fn.over(Window.partitionBy("k").orderBy(*sort(order))).cast("bigint"))
    assert rows(got, "id", "r") == rows(want, "id", "r")


@pytest.mark.parametrize("n", [1, 3, -2])
def test_shift(skewed, n):
    got = O.shift(skewed, ["k"], ORDER, {"a": "id", "b": "v"}, n, group_rows=0)
    w = Window.partitionBy("k").orderBy(*sort(ORDER))
    want = skewed.withColumns({"a": F.lag("id", n).over(w), "b": F.lag("v", n).over(w)})
    assert rows(got, "id", "a", "b") == rows(want, "id", "a", "b")


def test_last_known(skewed):
    thin = skewed.withColumn("v", F.when(F.col("id") % 97 == 0, F.col("v")))  # long gaps cross several slices
    got = O.last_known(thin, ["k"], ["o", "id"], "v", "x", group_rows=0)
    w = Window.partitionBy("k").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = thin.withColumn("x", F.last("v", ignorenulls=True).over(w))
    assert rows(got, "id", "x") == rows(want, "id", "x")


def test_as_of_latest_both_ways(skewed):
    left = skewed.where("id % 2 = 0").select("id", "k", "o")
    log = skewed.where("id % 2 = 1").select("id", "k", "o", "v")
    one = J.as_of_latest(left, log, ["k"], "o", {"w": "v", "from_id": "id"}, tie=["id"])
    two = J.as_of_latest(left, log, ["k"], "o", {"w": "v", "from_id": "id"}, tie=["id"], group_rows=0)
    assert rows(one) == rows(two)


def test_ordered_string_agg(skewed):
    one = A.ordered_string_agg(skewed, ["k"], ["o", "id"], "v", "t")
    two = A.ordered_string_agg(skewed, ["k"], ["o", "id"], "v", "t", group_rows=0)
    assert rows(one) == rows(two)


def test_dense_keys(spark, skewed):
    got = O.dense_keys(skewed.select("id"), ["id"], "n", 10)
    assert rows(got, "id", "n") == rows(spark.range(3000).select("id", F.col("id") + 11))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_with_hot_keys(skewed, how):
    right = skewed.where("o < 400").groupBy("k", "v").agg(F.max("id").alias("top"))
    plain = lookup(skewed, right, {"k": "k", "v": "v"}, ["top"], how)
    salted = lookup(skewed, right, {"k": "k", "v": "v"}, ["top"], how, hot_rows=40)
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "strategy=broadcast" in plan and "monotonically_increasing_id" not in plan  # by key, never by position
    assert rows(salted, "id", "k", "o", "v", "top") == rows(plain, "id", "k", "o", "v", "top")


def test_empty_groups(skewed):
    none = skewed.where("false")
    assert O.running_sum(none, ["k"], ORDER, "v", "s", group_rows=0).isEmpty()
    assert O.rank(none, ["k"], ORDER, "r", group_rows=0).isEmpty()
    assert O.shift(none, ["k"], ORDER, {"p": "id"}, group_rows=0).isEmpty()
    assert O.dense_keys(none, ["id"], "n").isEmpty()


def test_minutes_in_a_row(spark):
    df = spark.createDataFrame([("2024-01-01 00:14:30",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = R.nth_minute(df, "t", 60, 2, lambda m: F.minute(m).isin(0, 15, 45), "n").first()["n"]
    assert str(got) == "2024-01-01 00:45:00"
    series = R.minute_series(df, [], "t", 2, "m").select("m").collect()
    assert [str(r[0])[11:16] for r in series] == ["00:14", "00:15", "00:16"]


def test_groups_of_one_task_need_no_slices(skewed):
    assert O.largest_group(skewed, ["k"]) >= 1000
    plan = O.running_sum(skewed, ["k"], ["id"], "v", "s")._jdf.queryExecution().toString()
    assert "__slice" not in plan

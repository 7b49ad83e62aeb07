"""NULLs, ties and types: what an operator does with them doesn't depend on the plan it takes."""

from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import aggregates as A
from tidemark.operators import joins as J
from tidemark.operators import ordered as O
from tidemark.operators import predicates as P
from tidemark.operators import runlog as R
from tidemark.operators.skew import lookup
from tidemark.plans import tables as K

SCHEMA = "k string, t int, v decimal(18,2)"


def entries(spark):
    data = [("a", None, 1), ("a", 1, None), ("a", 3, 2), ("b", 2, 5), (None, 2, 7), ("a", 7, 4)]
    return spark.createDataFrame([(k, t, v) for k, t, v in data], "k string, t int, v int").withColumn("v", F.col("v").cast("decimal(18,2)"))


def test_both_plans_agree(spark):
    df = entries(spark)
    for group_rows in (0, 10**9):
        sums = O.running_sum(df, ["k"], [O.By("t", nulls_first=True)], "v", "s", group_rows)
        assert sums.schema["s"].dataType.simpleString() == "decimal(28,2)"
        known = O.last_known(df, ["k"], ["t"], "v", "l", group_rows)
        assert [float(x[0]) for x in rows(known.where("k = 'a'").orderBy("t"), "l")] == [1.0, 1.0, 2.0, 4.0]
        text = A.ordered_string_agg(df.withColumn("w", F.coalesce(F.col("t").cast("string"), F.lit("n"))), ["k"], ["t"], "w", "s", group_rows=group_rows)
        assert rows(text.where("k = 'a'"), "s") == [("n,1,3,7",)]
    same = [rows(O.running_sum(df, ["k"], [O.By("t")], "v", "s", n)) for n in (0, 10**9)]
    assert same[0] == same[1]


def test_as_of_matches_no_nulls(spark):
    log = entries(spark).withColumnRenamed("v", "w")
    facts = spark.createDataFrame([("a", 0), ("a", 5), ("a", None), (None, 9), ("b", 9), ("b", 1)], "k string, t int")
    for group_rows in (0, 10**9):
        got = J.as_of_latest(facts, log.withColumn("n", F.lit(1)), ["k"], "t", {"at": "n", "w": "w"}, group_rows=group_rows)
        found = {(r.k, r.t): None if r["at"] is None else (None if r.w is None else float(r.w)) for r in got.collect()}
        hit = {(r.k, r.t): r["at"] for r in got.collect()}
        assert hit == {("a", 0): None, ("a", 5): 1, ("a", None): None, (None, 9): None, ("b", 9): 1, ("b", 1): None}
        assert found[("a", 5)] == 2.0 and found[("b", 9)] == 5.0


def test_lookup_takes_maps_and_spreads_equal_rows(spark):
    left = spark.range(1000).select(F.lit("hot").alias("k"), F.create_map(F.lit("x"), F.lit(1)).alias("m"))
    right = spark.createDataFrame([("hot", 5), (None, 6)], "k string, v int")
    assert lookup(left, right, {"k": "k"}, ["v"], hot_rows=10).where("v = 5").count() == 1000


def test_code_grid_has_null_codes(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "x string, y int")
    assert rows(J.code_grid(df, ["x", "y"])) == sorted([("a", 1), ("a", 2), (None, 1), (None, 2)], key=repr)


def test_whole_strings_only(spark):
    df = spark.createDataFrame([("ab",), ("ab\n",), ("xab",)], "s string")
    assert rows(df.where(P.similar_to("s", "ab|b"))) == [("ab",)]


def test_capacity(spark):
    waiting = spark.createDataFrame([(i, "r", 1, 0.9) for i in range(5)] + [(9, "free", 1, 0.5)], "run int, r string, imp int, load double")
    capacity = spark.createDataFrame([("r", 1)], "r string, capacity int")
    got = R.admit_by_capacity(waiting, capacity, "r", "run", "imp", "load")
    assert [x[0] for x in rows(got, "run")] == [0, 9]


def test_unfinished_members_gate(spark):
    df = spark.createDataFrame(
        [("s", 1, 1, 0, 5), ("s", 1, 2, 0, None), ("s", 2, 1, 9, 10), ("u", 1, 1, 0, 5), ("u", 2, 1, 4, 6), ("u", 2, 2, 5, 6)],
        "q string, slot int, member int, a int, b int")
    got = R.prefix_gate(df, ["q"], "slot", "member", "a", "b")
    assert rows(got, "q", "slot", "member", "gate") == sorted([("s", 2, 1, None), ("u", 2, 1, 5)], key=repr)


def test_null_status_is_reported(spark):
    legal = next(after for before, after in R.TRANSITIONS if before is None)
    log = spark.createDataFrame([(1, 1, legal), (1, 2, None), (1, 3, legal), (2, 1, None)], f"run int, n int, s {'int' if isinstance(legal, int) else 'string'}")
    got = R.illegal_transitions(log, ["run"], ["n"], "s")
    assert rows(got, "run", "n") == [(1, 2), (1, 3), (2, 1)]


def test_overdue_below_a_second(spark):
    runs = spark.createDataFrame([(1, "2020-01-01 00:00:00.000"), (2, "2020-01-01 00:00:00.100")], "id int, since string").withColumns(
        {"since": F.col("since").cast("timestamp"), "st": F.lit("run")})
    limits = spark.createDataFrame([("run", 30)], "status string, minutes int")
    got = R.overdue(runs, limits, "st", "since", F.lit("2020-01-01 00:30:00.050").cast("timestamp"))
    assert rows(got, "id") == [(1,)]


def test_no_conditions(spark):
    instances = spark.createDataFrame([("n", ["a"], "ok")], "name string, identifier array<string>, status string")
    none = spark.createDataFrame([], "id int, name string, pattern array<string>, status string, negated boolean")
    assert R.eval_pattern_condition(instances, none).count() == 0


def test_relink_matches_null_keys(spark):
    feed = spark.createDataFrame([(10, None, "root", None), (11, 10, "leaf", None)], "id int, parent_id int, a string, b string")
    instances = spark.createDataFrame([(1, 99, "root", None), (2, 98, "leaf", None), (3, 97, "other", "x")], "id int, parent_id int, a string, b string")
    got = K.relink_parent(instances, feed, ["a", "b"])
    assert rows(got, "id", "parent_id") == sorted([(1, None), (2, 1), (3, 97)], key=repr)

"""Truth tables and run-log rules."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import predicates as P
from tidemark.operators import runlog as L

ST = L.STATUSES


def test_condition_table(spark):
    pairs = [(r, a) for r in ST for a in ST]
    df = spark.createDataFrame(pairs, "r string, a string").withColumn("v", L.condition_verdict("r", "a"))
    for r, a, v in rows(df):
        assert v == ("run" if r == a else "skip" if a in ("succeeded", "skipped") else "wait")
    assert spark.range(1).select(L.condition_verdict(F.lit("failed"), F.lit(None).cast("string"))).first()[0] == "wait"


# Status of "A || B", a row per status of A and a column per status of B.
PARALLEL = {
    "submitted": ["submitted", "running", "running", "running", "running", "running"],
    "running": ["running"] * 6,
    "failed": ["running", "running", "failed", "failed", "failed", "failed"],
    "suspended": ["running", "running", "failed", "suspended", "suspended", "suspended"],
    "succeeded": ["running", "running", "failed", "suspended", "succeeded", "succeeded"],
    "skipped": ["running", "running", "failed", "suspended", "succeeded", "skipped"],
}


def test_parallel_table(spark):
    data = [(f"{a}/{b}", s) for a in [*ST, None] for b in [*ST, None] for s in (a, b)]
    df = spark.createDataFrame(data, "g string, s string")
    for g, status in rows(L.rollup_parallel(df, ["g"], "s")):
        a, b = [None if x == "None" else x for x in g.split("/")]
        want = b if a is None else a if b is None else PARALLEL[a][ST.index(b)]
        assert status == want, g


def fold(members):
    acc = members[-1]
    for s in reversed(members[:-1]):
        acc = L.IN_SEQUENCE[s][ST.index(acc)] if acc else None
    return acc


@pytest.mark.parametrize("block, group_rows", [(4096, 10**6), (2, 10**6), (3, 0)])
def test_sequence_folds_from_the_right(spark, block, group_rows):
    rnd = random.Random(4)
    groups = {f"{a}>{b}": [a, b] for a in ST for b in ST}
    for n in range(1, 40):
        groups[f"long {n}"] = ["succeeded", "skipped"] * n + [rnd.choice(ST) for _ in range(rnd.randint(1, 2))]
        groups[f"any {n}"] = [rnd.choice(ST) for _ in range(rnd.randint(1, 5))]
    data = [(g, i, s) for g, members in groups.items() for i, s in enumerate(members)]
    df = spark.createDataFrame(data, "g string, i int, s string").repartition(5)
    got = L.rollup_sequence(df, ["g"], ["i"], "s", block=block, group_rows=group_rows)
    assert dict(rows(got)) == {g: fold(m) for g, m in groups.items()}


@pytest.mark.parametrize("kind, fn", [("and", min), ("or", max)])
def test_condition_connectives(spark, kind, fn):
    data, want = [], {}
    for i, a in enumerate(L.VERDICTS):
        for j, b in enumerate(L.VERDICTS):
            root = f"{a}{b}"
            data += [(root, None, kind, None), (root + "1", root, None, a), (root + "2", root, None, b)]
            want[root] = L.VERDICTS[fn(i, j)]
    df = spark.createDataFrame(data, "id string, up string, c string, v string")
    got = dict(rows(L.eval_condition_tree(df, "id", "up", "c", "v").where("up is null"), "id", "v"))
    assert got == want


def test_boolean_tree(spark):
    data = [
        (1, None, "not", None), (2, 1, "or", None), (3, 2, None, False), (4, 2, None, None), (5, 2, "and", None),
        (6, 5, None, True), (7, 5, None, False),
    ]
    df = spark.createDataFrame(data, "id int, up int, c string, r boolean")
    got = dict(rows(L.eval_boolean_tree(df, "id", "up", "c", "r"), "id", "r"))
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: False}


@pytest.mark.parametrize("group_rows", [10**6, 0])
def test_admission(spark, group_rows):
    rnd = random.Random(1)
    waiting = [(i, rnd.choice("aaab"), rnd.choice([None, 1, 5, 9]), rnd.choice([None, 1, 2, 7])) for i in range(400)]
    caps = {"a": 150, "b": None}
    df = spark.createDataFrame(waiting, "run int, res string, imp int, load int")
    cap = spark.createDataFrame(list(caps.items()), "res string, capacity int")
    used = spark.createDataFrame([("a", 20), ("a", 10)], "res string, load int")
    got = L.admit_by_capacity(df, cap, "res", "run", "imp", "load", used=used, group_rows=group_rows)
    want = []
    for res, limit in caps.items():
        mine = [w for w in waiting if w[1] == res]
        mine.sort(key=lambda w: (w[2] is None, -(w[2] or 0), w[3] is not None, w[3] or 0, w[0]))
        total = 0
        for w in mine:
            total += 1 if w[3] is None else w[3]
            if limit is None or total <= limit - 30:
                want.append(w[0])
    assert rows(got, "run") == sorted([(r,) for r in want], key=repr)


def greedy(waiting, caps, taken):
    """Runs and running sums by a literal loop."""
    want = []
    for res in sorted({w[1] for w in waiting}, key=repr):
        limit = caps.get(res)
        free = None if limit is None else limit - taken.get(res, 0)
        mine = sorted((w for w in waiting if w[1] == res), key=lambda w: (w[2] is None, -(w[2] or 0), w[3] is not None, w[3] or 0, w[0]))
        total = 0
        for w in mine:
            size = 1 if w[3] is None else w[3]
            if free is None or size <= free:
                total += size
                free = None if free is None else free - size
                want.append((w[0], total))
    return sorted(want, key=repr)


@pytest.mark.parametrize("seed, block", [(1, 3), (2, 7), (3, 16_384)])
def test_greedy_admission(spark, seed, block):
    rnd = random.Random(seed)
    caps = {"a": 100, "b": 0, "c": None, "d": 35, "e": 400, None: 5}
    waiting = [(i, rnd.choice(["a", "b", "c", "d", "e", "nowhere", None]), rnd.choice([None, 1, 2, 3]), rnd.choice([None, 0, 1, 2, 5, 30, 90])) for i in range(300)]
    df = spark.createDataFrame(waiting, "run int, res string, imp int, load int")
    cap = spark.createDataFrame([(k, v) for k, v in caps.items() if k], "res string, capacity int")
    used = spark.createDataFrame([("a", 20), ("a", 10), ("d", 40)], "res string, load int")
    got = L.admit_greedy(df, cap, "res", "run", "imp", "load", used=used, block=block)
    caps = {k: v for k, v in caps.items() if k}
    assert rows(got, "run", "load_sum") == greedy(waiting, caps, {"a": 30, "d": 40})


def test_greedy_admission_skips_over_many_runs(spark, monkeypatch):
    """One resource, every second load too large: few rounds, and the runs lie in many blocks."""
    rounds = []
    monkeypatch.setattr(L, "_greedy_fold", lambda *x, fold=L._greedy_fold: rounds.append(1) or fold(*x))
    n = 40_000
    waiting = [(i, "r", 0, 1000 + i % 2 * 10**6 if i < n // 2 else 1 + i % 3) for i in range(n)]
    df = spark.createDataFrame(waiting, "run int, res string, imp int, load int").withColumn("imp", -F.col("run"))
    waiting = [(i, r, -i, x) for i, r, _, x in waiting]
    cap = spark.createDataFrame([("r", 3_500_123)], "res string, capacity int")
    got = L.admit_greedy(df, cap, "res", "run", "imp", "load", block=1000)
    assert rows(got, "run", "load_sum") == greedy(waiting, {"r": 3_500_123}, {})
    assert len(rounds) <= 10


def test_greedy_admission_of_decimals_and_nothing(spark):
    df = spark.createDataFrame([(1, "r", 1, "0.70"), (2, "r", 1, "0.40"), (3, "r", 1, "0.31")], "run int, res string, imp int, load string")
    df = df.withColumn("load", F.col("load").cast("decimal(5,2)"))
    cap = spark.createDataFrame([("r", 1)], "res string, capacity int")
    got = {r["run"]: str(r["load_sum"]) for r in L.admit_greedy(df, cap, "res", "run", "imp", "load").collect()}
    assert got == {3: "0.31", 2: "0.71"}
    assert L.admit_greedy(df.limit(0), cap, "res", "run", "imp", "load").collect() == []
    bad = df.withColumn("load", F.lit(-1))
    with pytest.raises(Exception, match="negative load"):
        L.admit_greedy(bad, cap, "res", "run", "imp", "load").collect()


def test_transitions(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    log = [(1, t(i), s) for i, s in enumerate(["submitted", "running", "failed", "submitted", "succeeded"])]
    log += [(2, t(0), "running"), (2, t(1), "suspended"), (2, t(2), "skipped"), (2, t(3), "failed")]
    df = spark.createDataFrame(log, "run int, ts timestamp_ntz, s string")
    want = [(1, "submitted", "succeeded"), (2, None, "running"), (2, "skipped", "failed")]
    for group_rows in (10**6, 0):
        bad = L.illegal_transitions(df, ["run"], ["ts"], "s", group_rows)
        assert rows(bad, "run", "previous", "s") == sorted(want, key=repr)


def test_retry_and_gate(spark):
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    log = [(1, t(1, i), "failed") for i in range(5)] + [(1, t(1, 9), "running")]
    df = spark.createDataFrame(log, "run int, ts timestamp_ntz, s string")
    policy = [L.Retry(2, "submit same", 5), L.Retry(1, "fail caller", 60)]
    got = L.retry_state(df, ["run"], ["ts"], F.col("s") == "failed", "ts", policy, "suspend")
    assert [r[:2] for r in rows(got, "attempt", "action", "retry_at")] == [
        (1, "submit same"), (2, "submit same"), (3, "fail caller"), (4, "suspend"), (5, "suspend"),
    ]
    runs = [("s", 1, 1, t(1), t(1, 5)), ("s", 1, 2, t(1, 5), t(3)), ("s", 2, 1, t(2), t(2, 5)), ("s", 2, 2, t(4), t(5))]
    df = spark.createDataFrame(runs, "q string, slot int, m int, a timestamp_ntz, z timestamp_ntz")
    assert rows(L.prefix_gate(df, ["q"], "slot", "m", "a", "z"), "slot", "m") == [(2, 1)]


def test_overdue_and_timed_condition(spark):
    now = P.ntz("2024-01-01 01:00:00")
    df = spark.createDataFrame(
        [(1, "running", dt.datetime(2024, 1, 1, 0, 29)), (2, "running", dt.datetime(2024, 1, 1, 0, 30)),
         (3, "skipped", dt.datetime(2024, 1, 1))],
        "run int, s string, ts timestamp_ntz",
    )
    limits = spark.createDataFrame([("running", 30)], "status string, minutes int")
    assert rows(L.overdue(df, limits, "s", "ts", now), "run", "seconds") == [(1, 31 * 60)]
    verdict = L.timed_verdict(F.lit("running"), F.col("s"), F.col("ts"), now, F.make_dt_interval(mins=F.lit(30)))
    assert rows(df.select("run", verdict.alias("v"))) == [(1, "run"), (2, "wait"), (3, "skip")]


def test_patterns(spark):
    inst = spark.createDataFrame(
        [("W", ["a", "X"], "running"), ("W", ["b", "X"], "failed"), ("W", ["b", "Y"], "running"), ("V", ["X"], "running")],
        "name string, identifier array<string>, status string",
    )
    cond = spark.createDataFrame(
        [
            (1, "W", ["*", "X"], "running", True), (2, "W", ["*", "Y"], "running", False), (3, "W", ["*", "X"], "running", False),
            (4, "W", ["*", "Z"], "running", True), (5, "W", ["*", "Z"], "running", False), (6, "W", ["*"], "running", True),
            (7, "V", ["*"], "running", False), (8, "W", ["*", "*"], "succeeded", True), (9, "W", ["b", "X"], "failed", False),
        ],
        "id int, name string, pattern array<string>, status string, negated boolean",
    )
    got = {r["id"]: (r["matches"], r["holds"]) for r in L.eval_pattern_condition(inst, cond).collect()}
    assert got == {
        1: (2, False), 2: (1, True), 3: (2, False), 4: (0, True), 5: (0, False), 6: (0, True), 7: (1, True),
        8: (3, True), 9: (1, True),
    }


def test_many_patterns_of_many_shapes(spark):
    """Two thousand patterns, every arrangement of stars, nulls and repeats among them, against a loop over all pairs."""
    rnd = random.Random(6)
    token = lambda: rnd.choice(["a", "b", "c", "d", None, "*"])
    instances = [(rnd.choice(["n", "n", "m", None]), [token() for _ in range(rnd.randrange(0, 6))] if rnd.random() < 0.97 else None, rnd.choice(["run", "ok", None])) for _ in range(250)]
    conditions = [(i, rnd.choice(["n", "n", "m", "none"]), [rnd.choice(["*", token()]) for _ in range(rnd.randrange(0, 6))], rnd.choice(["run", "ok"]), rnd.random() < 0.5) for i in range(2000)]
    got = L.eval_pattern_condition(spark.createDataFrame(instances, "name string, identifier array<string>, status string"),
                                   spark.createDataFrame(conditions, "id int, name string, pattern array<string>, status string, negated boolean"))
    want = []
    for i, name, pattern, status, negated in conditions:
        hit = [s for n, ident, s in instances if n == name and ident is not None and len(ident) == len(pattern) and all(p == "*" or p == e for p, e in zip(pattern, ident))]
        same = sum(s == status for s in hit)
        want.append((i, len(hit), same == 0 if negated else len(hit) > 0 and same == len(hit)))
    assert rows(got, "id", "matches", "holds") == sorted(want, key=repr)

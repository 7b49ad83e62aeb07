"""Properties of valid-time history."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from tidemark.operators import predicates as P
from tidemark.operators import reshape as R
from tidemark.plans import history as H
from tidemark.plans import tables as K

SCHEMA = "a int, b string, x int, y string, start_ts timestamp_ntz, end_ts timestamp_ntz"
IDS = ["a", "b"]


def ts(day):
    return f"2020-01-{day:02d} 00:00:00"


def image(spark, data):
    return spark.createDataFrame([(*k, *v) for k, v in data.items()], "a int, b string, x int, y string")


def snapshots(days, seed=5):
    """Random small images: keys vanish and return, values change, NULL included."""
    rnd = random.Random(seed)
    keys = [(a, b) for a in range(4) for b in "pq"]
    return {
        d: {k: (rnd.choice([1, 2, None]), rnd.choice(["u", None])) for k in keys if rnd.random() < 0.7} for d in days
    }


def brute(images):
    """Versions by walking through the snapshots."""
    live, out = {}, []
    for d in sorted(images):
        img = images[d]
        for k in list(live):
            if k not in img or img[k] != live[k][0]:
                value, since = live.pop(k)
                out.append((*k, *value, ts(since), ts(d)))
        for k, value in img.items():
            if k not in live:
                live[k] = (value, d)
    out += [(*k, *v, ts(since), P.OPEN_END) for k, (v, since) in live.items()]
    return sorted(out, key=repr)


def shown(df):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows(df, "a", "b", "x", "y", text("start_ts"), text("end_ts"))


@pytest.fixture(scope="module")
def folded(spark):
    images = snapshots(range(1, 7))
    empty = spark.createDataFrame([], SCHEMA)
    return images, H.fold_snapshots(empty, [(ts(d), image(spark, i)) for d, i in images.items()], IDS)


def test_fold_equals_brute_force(folded):
    images, history = folded
    assert shown(history) == brute(images)


def test_versions_do_not_overlap_and_one_is_open(folded):
    images, history = folded
    by_key = {}
    for a, b, _, _, start, end in shown(history):
        assert start < end
        by_key.setdefault((a, b), []).append((start, end))
    for spans in by_key.values():
        spans.sort()
        assert all(p[1] <= q[0] for p, q in itertools.pairwise(spans))
    assert {k for k, s in by_key.items() if s[-1][1] == P.OPEN_END} == set(images[6])


def test_snapshot_is_what_is_valid_at_its_time(folded):
    images, history = folded
    for d, img in images.items():
        assert rows(P.valid_at(history, ts(d)), "a", "b", "x", "y") == sorted([(*k, *v) for k, v in img.items()], key=repr)


def test_replay_changes_nothing(spark, folded):
    images, history = folded
    assert shown(H.scd2_apply(history, image(spark, images[6]), IDS, ts(6))) == brute(images)
    assert shown(H.scd2_apply(history, image(spark, images[6]), IDS, ts(9))) == brute(images)


@pytest.mark.parametrize("day", [1, 3, 6])
def test_reload_from(spark, folded, day):
    images, _ = folded
    good = [(ts(d), image(spark, i)) for d, i in images.items()]
    bad = [(t, i if t < ts(day) else i.withColumn("x", F.lit(99))) for t, i in good]
    wrong = H.fold_snapshots(spark.createDataFrame([], SCHEMA), bad, IDS)
    assert shown(H.reload_from(wrong, good, IDS, ts(day))) == brute(images)


def test_diffs_agree_with_the_fused_form(spark, folded):
    _, history = folded
    new = image(spark, snapshots([1], seed=9)[1])
    ops = H.classify_changes(history, new, IDS, ts(8)).select(*IDS, "op").collect()
    by = lambda op: sorted((r["a"], r["b"]) for r in ops if r["op"] == op)
    assert rows(H.diff_deletes(history, new, IDS, ts(8))) == by("D")
    assert rows(H.diff_inserts(history, new, IDS, ts(8)), *IDS) == by("I")
    assert rows(H.diff_updates(history, new, IDS, ts(8)), *IDS) == by("U")


def test_repeated_or_null_keys_fail(spark, folded):
    _, history = folded
    twice = spark.createDataFrame([(1, "p", 1, "u"), (1, "p", 2, "u")], "a int, b string, x int, y string")
    with pytest.raises(Exception, match="more than once"):
        H.scd2_apply(history, twice, IDS, ts(9)).collect()
    unknown = spark.createDataFrame([(1, None, 1, "u")], "a int, b string, x int, y string")
    with pytest.raises(Exception, match="NULL in key"):
        H.scd2_apply(history, unknown, IDS, ts(9)).collect()


def test_nothing_to_compare_means_no_update(spark):
    target = spark.createDataFrame([(1, "p")], "a int, b string").select(
        "a", "b", P.ntz(ts(1)).alias("start_ts"), P.ntz(P.OPEN_END).alias("end_ts")
    )
    new = spark.createDataFrame([(1, "p"), (2, "p")], "a int, b string")
    assert rows(H.diff_updates(target, new, IDS, ts(2))) == []
    assert rows(H.classify_changes(target, new, IDS, ts(2)), "a", "op") == [(1, "="), (2, "I")]


def test_empty_image_closes_everything_in_a_stored_history(spark):
    images = snapshots(range(1, 4))
    images[4] = {}
    images[5] = snapshots([1], seed=2)[1]
    name = K.work_table(spark, "hist")
    K.create_history(spark, name, spark.createDataFrame([], SCHEMA).schema)
    for d, img in images.items():
        new = image(spark, img) if img else spark.createDataFrame([], "a int, b string, x int, y string")
        K.apply_to_history(spark, name, new, IDS, ts(d))
    assert shown(spark.table(name)) == brute(images)


def test_delta_takes_the_last_operation(spark):
    base = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, v int")
    feed = spark.createDataFrame(
        [(1, 11, "UPDATE", 1), (1, 0, "DELETE", 2), (2, 0, "DELETE", 3), (2, 21, "INSERT", 4), (4, 40, "INSERT", 5)],
        "id int, v int, op string, seq int",
    )
    assert rows(H.load_delta(base, feed, ["id"], "op", "seq")) == [(2, 21), (3, 30), (4, 40)]


def test_increment(spark):
    base = spark.createDataFrame([(1, 1), (2, 2)], "id int, seq int")
    feed = spark.createDataFrame([(2, 2), (3, 3), (3, 3), (4, 4)], "id int, seq int")
    assert rows(H.load_increment(base, feed, ["id"], "seq")) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert rows(H.load_increment(base.limit(0), feed, ["id"], "seq")) == [(2, 2), (3, 3), (4, 4)]


def test_surrogates(spark):
    known = spark.createDataFrame([("b", 7), ("b", 7), ("x", 3)], "n string, id bigint")
    new = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "n string")
    assert rows(H.assign_surrogate(new, known, ["n"], "id"), "n", "id") == [("a", 8), ("a", 8), ("b", 7), ("c", 9)]
    assert rows(H.assign_surrogate(new, known.limit(0), ["n"], "id"), "n", "id") == [("a", 1), ("a", 1), ("b", 2), ("c", 3)]


def test_lists(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "z")], "k int, t string")
    assert rows(R.split_ordered(df, ["k"], "t", " ", "w")) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (4, 1, "z")]
    with pytest.raises(ValueError):
        R.chunk_list(["CRM", "SCD2"], ["Source", "Method", "IdList"])


def stored_history(spark):
    name = K.work_table(spark, "history")
    K.create_history(spark, name, T._parse_datatype_string("id int, v string, start_ts timestamp_ntz, end_ts timestamp_ntz"))
    image = lambda *r: spark.createDataFrame(list(r), "id int, v string")
    seen = lambda: rows(spark.table(name).select("id", "v", F.year("start_ts").alias("a"), F.year("end_ts").alias("b")))
    return name, image, seen


def test_a_load_may_run_again(spark):
    name, image, seen = stored_history(spark)
    K.apply_to_history(spark, name, image((1, "a"), (2, "a")), ["id"], "2020-01-01 00:00:00")
    K.apply_to_history(spark, name, image((1, "b"), (2, "a")), ["id"], "2021-01-01 00:00:00")
    want = [(1, "a", 2020, 2021), (1, "b", 2021, 9999), (2, "a", 2020, 9999)]
    assert seen() == want
    K.apply_to_history(spark, name, image((1, "b"), (2, "a")), ["id"], "2021-01-01 00:00:00")
    assert seen() == want
    K.apply_to_history(spark, name, image((1, "b"), (2, "c")), ["id"], "2021-01-01 00:00:00")
    assert seen() == [(1, "a", 2020, 2021), (1, "b", 2021, 9999), (2, "a", 2020, 2021), (2, "c", 2021, 9999)]
    K.apply_to_history(spark, name, image((1, "a"), (2, "a")), ["id"], "2021-01-01 00:00:00")
    assert seen() == [(1, "a", 2020, 9999), (2, "a", 2020, 9999)]
    K.apply_to_history(spark, name, image((1, "b")), ["id"], "2022-01-01 00:00:00")
    before = seen()
    with pytest.raises(ValueError, match="older"):
        K.apply_to_history(spark, name, image((1, "x")), ["id"], "2021-06-01 00:00:00")
    assert seen() == before


def test_a_late_snapshot_fails(spark):
    target = spark.createDataFrame([(1, "a", "2020-01-01", "9999-12-31 23:59:59")], "id int, v string, start_ts string, end_ts string")
    target = target.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")})
    with pytest.raises(Exception, match="versions start after"):
        H.scd2_apply(target, spark.createDataFrame([(1, "b")], "id int, v string"), ["id"], "2019-01-01 00:00:00").collect()


def test_unnamed_sources_stay(spark):
    span = "start_ts timestamp_ntz, end_ts timestamp_ntz"
    target = spark.createDataFrame([(1, "a", "x", None, None), (2, "b", "y", None, None), (3, "c", None, None, None)], f"id int, v string, source string, {span}")
    assert H.load_by_method(target, {}, [], "2020-01-01 00:00:00").count() == 3
    with pytest.raises(ValueError, match="twice"):
        H.load_by_method(target, {}, [{"Source": "x"}, {"Source": "x"}], "2020-01-01 00:00:00")
    plain = target.drop("start_ts", "end_ts")
    out = H.load_by_method(plain, {"x": spark.createDataFrame([(1, "z")], "id int, v string")}, [{"Source": "x", "Method": "SCD1", "IdList": "id"}], "2020-01-01 00:00:00")
    assert rows(out, "id", "v") == [(1, "z"), (2, "b"), (3, "c")]


def test_bad_feeds_fail(spark):
    target = spark.createDataFrame([(1, "a")], "id int, v string")
    feed = lambda *r: spark.createDataFrame(list(r), "id int, v string, op string, seq int")
    for bad in ((1, "b", "UPDATE", None), (1, "b", "delete", 1), (1, "b", None, 1)):
        with pytest.raises(Exception, match="NULL in seq|unknown operation"):
            H.load_delta(target, feed(bad), ["id"], "op", "seq").collect()
    with pytest.raises(Exception, match="NULL in seq"):
        H.load_increment(target.withColumn("seq", F.lit(1)), feed((2, "b", "x", None)), ["id"], "seq").collect()
    history = target.withColumns({"start_ts": F.lit("2020-01-01").cast("timestamp_ntz"), "end_ts": F.lit("9999-12-31 23:59:59").cast("timestamp_ntz")})
    twice = spark.createDataFrame([(1, "x"), (1, "y"), (5, "x"), (5, "y")], "id int, v string")
    for diff in (H.diff_inserts, H.diff_updates):
        with pytest.raises(Exception, match="more than once"):
            diff(history, twice, ["id"], "2021-01-01 00:00:00").collect()

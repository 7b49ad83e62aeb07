"""Calendars against printed results and brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import calendars as C


def schedules(spark, specs):
    df = spark.createDataFrame(list(specs.items()), "id string, spec string")
    return C.as_alternatives(C.expand_cron(df, ["id"], "spec"), ["id"])


def sets(spec):
    """Sets of one alternative, read independently."""
    out = []
    parts = spec.replace("&", " ").split()
    if len(parts) == 5:
        parts.insert(3, "*")
    for part, (_, lo, hi) in zip(parts, C.FIELDS, strict=True):
        values = set()
        for item in part.split(","):
            if item == "*":
                values |= set(range(lo, hi + 1))
            else:
                a, _, b = item.partition("-")
                values |= set(range(int(a), int(b or a) + 1))
        out.append(values)
    return out


def brute_slots(spec, first, last):
    found = set()
    for alt in spec.split("|"):
        minutes, hours, days, rdays, months, wdays = sets(alt)
        d = first
        while d <= last:
            nxt = (d.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
            if d.day in days and (nxt - d).days in rdays and d.month in months and d.isoweekday() in wdays:
                found |= {dt.datetime(d.year, d.month, d.day, h, m) for h in hours for m in minutes}
            d += dt.timedelta(days=1)
    return sorted(found)


@pytest.mark.parametrize(
    "at, forward, same, want",
    [
        ("2017-12-15 18:00:00", True, False, "2017-12-15 18:15:00"),
        ("2017-12-15 16:00:00", True, False, "2017-12-15 18:00:00"),
        ("2017-12-15 18:00:00", False, True, "2017-12-15 18:00:00"),
        ("2017-12-15 18:00:00", False, False, "2017-12-15 02:45:00"),
    ],
)
def test_nearest_run(spark, at, forward, same, want):
    plan = schedules(spark, {"s": "0,15,45 & 0,1,2,18 & 15 & * & * & *"})
    row = plan.withColumn("ts", F.lit(at).cast("timestamp_ntz"))
    found = (C.next_run if forward else C.prev_run)(row, "ts", "r", same).first()["r"]
    assert str(found) == want


def test_classic_cron(spark):
    plan = schedules(spark, {"s": "14 3 1 * *|0 0 2 * *"}).withColumns({"a": F.lit("2015-05-01"), "b": F.lit("2015-06-30")})
    slots = [str(r[0]) for r in C.schedule_slots(plan, ["id"], "a", "b").select("slot_ts").orderBy("slot_ts").collect()]
    assert slots == ["2015-05-01 03:14:00", "2015-05-02 00:00:00", "2015-06-01 03:14:00", "2015-06-02 00:00:00"]


SPEC = "10,50 & 6-8 & 4 & * & * & * | 5 & 23 & * & 2 & 6,7 & * | 0 & 12 & 10-20 & * & 11 & 1-5 | 33 & 3 & * & * & 2 & 6"


def test_slots_of_four_alternatives(spark):
    plan = schedules(spark, {"s": SPEC}).withColumns({"a": F.lit("2019-12-20"), "b": F.lit("2020-10-05")})
    got = sorted(r[0] for r in C.schedule_slots(plan, ["id"], "a", "b").select("slot_ts").collect())
    assert got == brute_slots(SPEC, dt.date(2019, 12, 20), dt.date(2020, 10, 5))


def test_overlapping_alternatives_give_a_date_once(spark):
    plan = schedules(spark, {"s": "0 0 * * 1,7|0 0 * * 1-3"}).withColumns({"a": F.lit("2024-01-01"), "b": F.lit("2024-01-14")})
    dates = [str(r[0]) for r in C.schedule_dates(plan, ["id"], "a", "b").select("date").orderBy("date").collect()]
    assert dates == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-07", "2024-01-08", "2024-01-09", "2024-01-10", "2024-01-14"]


def test_backward_range_is_empty(spark):
    got = C.expand_cron(spark.createDataFrame([("5-3,7 * * * *",)], "spec string"), ["spec"], "spec").first()
    assert got["minutes"] == [7]


def test_alignment_equals_brute_force(spark):
    specs = {"s": SPEC, "leap": "0 12 29 2 *", "weekly": "5 0 * * 3|59 23 * * 5"}
    start = dt.datetime(2023, 11, 1)
    facts = [(k, start + dt.timedelta(hours=7 * i, minutes=13 * i)) for k in specs for i in range(400)]
    facts += [("s", dt.datetime(2024, 1, 1, 0, 0)), ("weekly", dt.datetime(2024, 1, 5, 23, 59))]
    df = spark.createDataFrame(facts, "id string, ts timestamp_ntz")
    span = df.groupBy("id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    got = C.align_to_schedule(df, schedules(spark, specs).join(span, "id"), "id", "ts").collect()
    slots = {k: brute_slots(s, dt.date(2019, 6, 1), dt.date(2028, 12, 31)) for k, s in specs.items()}
    assert len(got) == len(facts)
    for r in got:
        assert r["prev_slot"] == max(s for s in slots[r["id"]] if s <= r["ts"])
        assert r["next_slot"] == min(s for s in slots[r["id"]] if s > r["ts"])


def test_lookups_equal_brute_force_for_many_schedules(spark):
    rnd = random.Random(5)

    def field(lo, hi, star):
        return "*" if rnd.random() < star else ",".join(str(x) for x in sorted(rnd.sample(range(lo, hi + 1), rnd.randrange(1, 4))))

    def alternative():
        return " & ".join([field(0, 59, 0), field(0, 23, 0), field(1, 31, 0.5), field(1, 31, 0.7), field(1, 12, 0.4), field(1, 7, 0.5)])

    specs = {f"s{i}": "|".join(alternative() for _ in range(rnd.randrange(1, 3))) for i in range(25)}
    specs |= {"leap": "0 12 29 2 *", "daily": "0 0 * * *", "last": "59 & 23 & * & 1 & * & *", "never": "0 0 31 4 *", "first": "0 0 1 1 *"}
    times = [dt.datetime(2019, 12, 31, 23, 59), dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 29, 12), dt.datetime(2023, 10, 31, 0, 30)]
    facts = [(k, t) for k in specs for t in times]
    plans = C.with_index(schedules(spark, specs))
    df = spark.createDataFrame(facts, "id string, ts timestamp_ntz").join(plans, "id")
    df = C.prev_run(C.next_run(df, "ts", "n"), "ts", "p", same_allowed=True)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(__d" not in plan and "sequence(cast(ts" not in plan  # no row walks through the dates
    slots = {k: brute_slots(s, dt.date(2007, 1, 1), dt.date(2036, 12, 31)) for k, s in specs.items()}
    for r in df.select("id", "ts", "n", "p").collect():
        after, before = [s for s in slots[r["id"]] if s > r["ts"]], [s for s in slots[r["id"]] if s <= r["ts"]]
        for found, inside in ((r["n"], min(after, default=None)), (r["p"], max(before, default=None))):
            # What lies beyond the years looked at by hand must not be within them
            assert found == inside or inside is None and (found is None or not 2007 <= found.year <= 2036)


def test_previous_of_next_is_not_later(spark):
    plan = schedules(spark, {"s": SPEC})
    at = spark.range(60).select((F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id") * 37)).alias("ts"))
    pairs = at.withColumn("id", F.lit("s")).join(plan, "id")
    both = C.prev_run(C.next_run(pairs, "ts", "n"), "n", "p").select("ts", "n", "p").collect()
    assert all(r["n"] > r["ts"] >= r["p"] for r in both)


def test_horizon_is_1466_dates(spark):
    df = spark.createDataFrame([("2096-03-01",)], "d string").withColumn("d", F.to_date("d"))
    got = C.candidate_dates(df, [], "d", 1)
    assert got.count() == 1466 and got.agg(F.max("seq")).first()[0] == 1465
    plan = schedules(spark, {"s": "0 0 29 2 *"}).withColumn("ts", F.lit("2096-03-01 00:00:00").cast("timestamp_ntz"))
    assert C.next_run(plan, "ts", horizon=1466).first()["next_run"] is None
    assert str(C.next_run(plan, "ts").first()["next_run"]) == "2104-02-29 00:00:00"


def test_lookups_are_complete(spark):
    leap = [y for y in range(1800, 2600) if dt.date(y, 3, 1) - dt.date(y, 2, 28) == dt.timedelta(days=2)]
    for day in range(1, 8):
        plan = schedules(spark, {"s": f"0 0 29 2 {day}"}).withColumn("ts", F.lit("2096-03-01 00:00:00").cast("timestamp_ntz"))
        row = C.prev_run(C.next_run(plan, "ts"), "ts").first()
        fits = [dt.datetime(y, 2, 29) for y in leap if dt.date(y, 2, 29).isoweekday() == day]
        assert row["next_run"] == min(x for x in fits if x.year > 2096)
        assert row["prev_run"] == max(x for x in fits if x.year <= 2096)
    never = schedules(spark, {"s": "0 0 30 2 *"}).withColumn("ts", F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
    assert C.next_run(never, "ts").first()["next_run"] is None


def test_an_empty_set_hides_nothing(spark):
    plan = schedules(spark, {"s": "0 9-6 * * * | 0 5 20 * *"}).withColumn("ts", F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
    assert str(C.next_run(plan, "ts").first()["next_run"]) == "2024-03-20 05:00:00"


@pytest.mark.parametrize("spec", ["75 * * * *", "0 24 * * *", "x * * * *", "0 0 0 * *", "0 0 * 13 *", "1-2-3 * * * *", " * * * *"])
def test_bad_fields_fail(spark, spec):
    with pytest.raises(Exception, match="not in"):
        schedules(spark, {"s": spec}).collect()


def test_shift_slots(spark):
    df = spark.createDataFrame([("s", dt.datetime(2024, 1, d)) for d in range(1, 6)], "id string, t timestamp_ntz")
    got = C.shift_slots(df, ["id"], "t", 2, "x").orderBy("t").collect()
    assert [r["x"] and r["x"].day for r in got] == [3, 4, 5, None, None]
    assert rows(C.shift_slots(df, ["id"], "t", 0, "x"), "x") == rows(df, "t")

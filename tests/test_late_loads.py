"""Loads that come late, in pieces or again: every order of arrival has to end in the same history."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from tidemark.plans import history as H
from tidemark.plans import tables as K
from tidemark.session import new_folder
from tidemark.sources import extracts as X
from tidemark.streaming import landing as G

HISTORY = "id int, v string, w int, start_ts timestamp_ntz, end_ts timestamp_ntz"
OPEN = "9999-12-31 23:59:59"


def ts(day):
    return f"2020-01-{day:02d} 00:00:00"


def images(r, days):
    """Small images in which keys stay, change, vanish and return."""
    return {d: {k: (r.choice(["a", "b", None]), r.choice([1, None])) for k in range(8) if r.random() < 0.6} for d in days}


def in_order(loads):
    """(key, values, start, end) of the loads applied by time, by hand."""
    out, open_ = [], {}
    for d in sorted(loads):
        image = loads[d]
        for k in list(open_):
            if image.get(k) != open_[k][0] or k not in image:
                value, start = open_.pop(k)
                out.append((k, *value, ts(start), ts(d)))
        for k, value in image.items():
            open_.setdefault(k, (value, d))
    return sorted(out + [(k, *value, ts(start), OPEN) for k, (value, start) in open_.items()], key=repr)


def shown(df):
    return rows(df.select("id", "v", "w", *[F.substring(F.col(c).cast("string"), 1, 19).alias(c) for c in ("start_ts", "end_ts")]))


@pytest.mark.parametrize("seed", range(3))
def test_every_order_gives_one_history(spark, seed):
    r = random.Random(seed)
    days = sorted(r.sample(range(1, 28), 5))
    loads = images(r, days)
    order = r.sample(days, len(days)) + r.choices(days, k=2)  # two come again, with other content
    final, arrived = dict(loads), []
    again = {i: images(r, [d])[d] for i, d in enumerate(order[5:])}
    history = spark.createDataFrame([], HISTORY)
    for i, d in enumerate(order):
        image = loads[d] if i < 5 else again[i - 5]
        final[d] = image
        df = spark.createDataFrame([(k, *v) for k, v in image.items()], "id int, v string, w int")
        later = [x for x in arrived if x > d]
        history = H.scd2_insert(history, df, ["id"], ts(d), ts(min(later)) if later else None)
        history = spark.createDataFrame(history.collect(), HISTORY)
        arrived.append(d)
        assert shown(history) == in_order({x: final[x] for x in arrived})


def test_insert_rejects_repeated_and_missing_keys_and_keeps_the_rest(spark):
    history = spark.createDataFrame([(1, "a", 1, None, None), (2, "b", 1, None, None)], HISTORY)
    dated = history.withColumn("start_ts", F.when(F.col("id") == 1, F.lit(ts(1)).cast("timestamp_ntz"))).withColumn(
        "end_ts", F.when(F.col("id") == 1, F.lit(OPEN).cast("timestamp_ntz")))
    image = lambda *keys: spark.createDataFrame([(k, "x", 1) for k in keys], "id int, v string, w int")
    got = shown(H.scd2_insert(dated, image(3), ["id"], ts(5), ts(9)))
    assert (2, "b", 1, None, None) in got and len(got) == 4  # without dates it passes through
    for keys in ((3, 3), (None,)):
        with pytest.raises(Exception):
            H.scd2_insert(dated, image(*keys), ["id"], ts(5), ts(9)).collect()


def test_rows_out_of_reach_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        history = spark.createDataFrame([(1, "a", 1, None, None)], HISTORY)
        image = spark.createDataFrame([(1, "x", 1)], "id int, v string, w int")
        plan = H.scd2_insert(history, image, ["id"], ts(5), ts(9))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "CartesianProduct" not in plan and plan.count("Union") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


SCHEMA = T.StructType().add("id", T.IntegerType()).add("v", T.StringType()).add("w", T.IntegerType())


class Stream:
    def __init__(self, spark, late="insert"):
        self.spark, self.root, self.late = spark, new_folder(spark, "arrivals"), late
        self.progress, self.name = new_folder(spark, "progress"), K.work_table(spark, "history")
        K.create_history(spark, self.name, T._parse_datatype_string(HISTORY))
        os.makedirs(self.root)

    def put(self, day, image, mode="error"):
        df = self.spark.createDataFrame([(k, *v) for k, v in image.items()], SCHEMA).coalesce(1)
        X.write_extract(df, G.load_folder(self.root, 20200100000000 + day * 1000000), mode=mode)

    def run(self):
        G.stream_scd2(self.spark, self.root, self.progress, self.name, SCHEMA, ["id"], late=self.late).awaitTermination()

    def history(self):
        return shown(self.spark.table(self.name))


def test_stream_takes_loads_in_any_order_and_in_pieces(spark):
    r = random.Random(50)
    loads = images(r, [2, 5, 9])
    stream = Stream(spark)
    arrivals = [(d, k % 2) for d in loads for k in (0, 1)]
    r.shuffle(arrivals)
    have = {}
    for i, (d, part) in enumerate(arrivals):
        piece = {k: v for k, v in loads[d].items() if k % 2 == part}
        stream.put(d, piece, "append")
        have.setdefault(d, {}).update(piece)
        if i % 2 or i == len(arrivals) - 1:
            stream.run()
            assert stream.history() == in_order(have)
    stream.run()
    stream.progress = new_folder(spark, "progress")
    stream.run()  # all files seen again
    assert stream.history() == in_order(loads)


def test_a_file_rewritten_under_its_name_is_noticed(spark):
    stream = Stream(spark)
    first = {d: {1: ("a", 1), 2: ("b", 1)} for d in (2, 5, 9)}
    for d in first:
        stream.put(d, first[d])
    stream.run()
    folder = G.load_folder(stream.root, 20200105000000)
    path = next(os.path.join(folder, f) for f in os.listdir(folder) if f.startswith("part-"))
    with open(path, "a") as file:
        file.write("3;c;1\n")
    os.remove(os.path.join(folder, f".{os.path.basename(path)}.crc"))
    stream.run()
    assert stream.history() == in_order(first | {5: {**first[5], 3: ("c", 1)}})
    assert G.changed_loads(spark, stream.root, stream.name) == []


def test_a_strict_stream_stops(spark):
    stream = Stream(spark, "stop")
    for d in (9, 2):
        stream.put(d, {d: ("a", 1)})
        if d == 9:
            stream.run()
    with pytest.raises(Exception, match="came after"):
        stream.run()
    assert stream.history() == in_order({9: {9: ("a", 1)}})
    with pytest.raises(ValueError, match="late is"):
        Stream(spark, "perhaps").run()

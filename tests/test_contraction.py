"""Folds by contraction and inheritance by composition, against plain recursion and by the number of jobs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import contraction as C
from tidemark.operators import hierarchy as T
from tidemark.operators import runlog as L
from tidemark.session import shared_folder

SHAPES = {
    "chain": lambda r, i: i - 1,
    "star": lambda r, i: 0,
    "chains": lambda r, i: r.randrange(max(0, i - 3), i),
    "bushy": lambda r, i: r.randrange(i),
    "forest": lambda r, i: None if r.random() < 0.1 else r.randrange(i),
    "orphans": lambda r, i: 10_000 + i if r.random() < 0.1 else r.randrange(i),
    "caterpillar": lambda r, i: i - 2 if i % 2 == 0 else i - 1,
}


def tree(shape, n, seed=0):
    r = random.Random(seed)
    return {i: None if i == 0 else SHAPES[shape](r, i) for i in range(n)}


def folded(up, own, fold):
    kids = {i: [] for i in up}
    for i, p in up.items():
        if p in kids:
            kids[p].append(i)
    out = {}
    for i in sorted(up, reverse=True):
        out[i] = fold(i, [out[c] for c in kids[i]]) if kids[i] else own[i]
    return out


def known(values):
    return [v for v in values if v is not None]


def all_shapes(n, seed):
    """One forest of every shape, and one node alone."""
    up = {-1: None}
    for j, shape in enumerate(sorted(SHAPES)):
        up |= {1000 * j + i: None if p is None else 1000 * j + p for i, p in tree(shape, n, seed + j).items()}
    return up


def test_least_and_greatest_in_every_shape(spark):
    r = random.Random(7)
    up = all_shapes(90, 1)
    own = {i: r.choice([None, 1, 2, 3]) for i in up}
    con = {i: r.choice(["or", "and", "swap"]) for i in up}
    df = spark.createDataFrame([(i, up[i], own[i], con[i], "k", 1) for i in up], "id long, up long, v int, c string, k string, got int").repartition(3)

    def fold(i, values):
        v = known(values)
        if not v:
            return None
        return max(v) if con[i] == "or" else min(v) if con[i] == "and" else 4 - max(v)

    finish = lambda a, b: F.when(F.col("c") == "or", b).when(F.col("c") == "and", a).otherwise(4 - b)
    got = C.contract(df, "id", "up", "v", C.Levels(3, finish))
    assert got.columns == df.columns and got.dtypes == df.dtypes
    assert rows(got, "id", "v") == sorted(folded(up, own, fold).items(), key=repr)


@pytest.mark.parametrize("op", ["sum", "min", "max"])
def test_monoids_in_every_shape(spark, op):
    r = random.Random(8)
    up = all_shapes(40, 2)
    own = {i: r.choice([None, 1, 5, -3]) for i in up}
    df = spark.createDataFrame([(i, up[i], own[i]) for i in up], "id long, up long, v long")
    plain = {"sum": sum, "min": min, "max": max}[op]
    want = folded(up, own, lambda i, v: plain(known(v)) if known(v) else None)
    assert rows(C.contract(df, "id", "up", "v", C.Monoid(op)), "id", "v") == sorted(want.items(), key=repr)


def test_sums_of_decimals_and_text_keys(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "a", "1.10"), ("c", "a", None), ("d", "c", "2.25")], "id string, up string, v string")
    df = df.withColumn("v", F.col("v").cast("decimal(10,2)"))
    got = C.contract(df, "id", "up", "v", C.Monoid("sum"))
    assert [(i, str(v)) for i, v in rows(got, "id", "v")] == [("a", "3.35"), ("b", "1.10"), ("c", "2.25"), ("d", "2.25")]


def test_cycles_raise_and_nothing_is_nothing(spark):
    loop = spark.createDataFrame([(1, None, 1), (2, 3, 1), (3, 2, 1), (4, 3, 1)], "id int, up int, v int")
    with pytest.raises(ValueError, match="cycle"):
        C.contract(loop, "id", "up", "v", C.Monoid("sum"))
    assert C.contract(loop.limit(0), "id", "up", "v", C.Monoid("sum")).isEmpty()


def jobs(work):
    """Result of ``work()`` and how many times something was written while it ran."""
    written, some = [], C.settle_any
    C.settle_any = lambda df, c: written.append(1) or some(df, c)
    try:
        return work(), len(written)
    finally:
        C.settle_any = some


@pytest.mark.parametrize("n, shape", [(20_000, "chain"), (20_000, "star")])
def test_jobs_follow_the_logarithm(spark, n, shape):
    up = F.when(F.col("id") > 0, F.col("id") - 1 if shape == "chain" else F.lit(0))
    leaf = F.col("id") == n - 1 if shape == "chain" else F.col("id") > 0
    df = spark.range(n).select("id", up.alias("up"), F.when(leaf, F.lit(1)).cast("long").alias("v"))
    got, written = jobs(lambda: C.contract(df, "id", "up", "v", C.Monoid("sum")).agg(F.min("v"), F.max("v"), F.count("v")).first())
    assert tuple(got) == ((1, 1, n) if shape == "chain" else (1, n - 1, n))
    assert written <= 18


def test_boolean_tree_deep_in_nots(spark):
    """A chain of 600 nots with an and every fifth node: more levels than a plan could hold."""
    n = 600
    con = {i: "and" if i % 5 == 0 else "not" for i in range(n)}
    df = spark.createDataFrame([(i, i - 1 if i else None, con[i] if i < n - 1 else None, True if i == n - 1 else None) for i in range(n)], "id int, up int, c string, r boolean")
    want = {n - 1: True}
    for i in range(n - 2, -1, -1):
        want[i] = want[i + 1] if con[i] == "and" else not want[i + 1]
    got = L.eval_boolean_tree(df, "id", "up", "c", "r")
    assert dict(rows(got, "id", "r")) == want


def effective(up, layers):
    """Attributes by a walk from the root: each layer is rendered with what is known, then laid over it."""
    import re

    def render(t, m):
        if t is None:
            return None
        first, *rest = re.split(r"\$\{", t)
        out = first
        for p in rest:
            name, closed, tail = p.partition("}")
            out += (m.get(name) or "") + (tail if closed else "")
        return out

    out = {}
    for i in sorted(up):
        if up[i] is not None and up[i] not in out:
            continue  # its chain of parents breaks off
        m = dict(out[up[i]]) if up[i] is not None else {}
        for layer in layers[i]:
            m |= {k: render(v, m) for k, v in (layer or {}).items()}
        out[i] = m
    return out


def test_inheritance_equals_a_walk(spark):
    r = random.Random(11)
    up = {i: p for i, p in all_shapes(50, 3).items() if not 10_000 <= (p or 0)}
    texts = ["x", "${a}", "${a}${b}", "${c}!", "${nothing}", "", "a${", "${a", "}", "$b{a}", None, "${d}-"]

    def layer():
        return r.choice([None, {}, {r.choice("abcd"): r.choice(texts)}, {k: r.choice(texts) for k in "abc"}])

    layers = {i: [layer(), layer()] for i in up}
    # Texts that refer to themselves would grow with every level
    for i in up:
        layers[i] = [x if x is None else {k: v if v is None or len(v) < 8 or r.random() < 0.2 else "y" for k, v in x.items()} for x in layers[i]]
    df = spark.createDataFrame([(i, up[i], *layers[i]) for i in up], "id long, up long, one map<string,string>, two map<string,string>")
    got = T.inherit_attributes(df, "id", "up", ["one", "two"], "f")
    assert {x["id"]: x["f"] for x in got.collect()} == effective(up, layers)


def test_inheritance_down_a_long_chain(spark):
    n = 3000
    one = F.when(F.col("id") == 0, F.create_map(F.lit("a"), F.lit("top"))).when(F.col("id") == 2000, F.create_map(F.lit("b"), F.lit("${a} and ${b}")))
    df = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"), one.alias("m"))
    got = T.inherit_attributes(df, "id", "up", ["m"], "f").groupBy(F.to_json("f").alias("f")).count()
    assert sorted(map(tuple, got.collect())) == [('{"a":"top","b":"top and "}', n - 2000), ('{"a":"top"}', 2000)]


def flattened(nodes):
    """Forests by recursion; ``nodes``: (task, call, id) to (parent, position, kind)."""
    kids = {}
    for (t, c, i), (p, pos, _) in nodes.items():
        kids.setdefault((t, c, p), []).append((pos, i))
    out = []

    def walk(t, c, i, keeper, put):
        kind = nodes[t, c, i][2]
        if keeper is not None and kind == nodes[t, c, keeper][2]:
            mine, keep = put, keeper
        else:
            put.append(i)
            mine, keep = [], i
            out.append((t, c, i, keeper, len(put) - 1, kind))
        for _, k in sorted(kids.get((t, c, i), [])):
            walk(t, c, k, keep, mine)

    for t, c, p in list(kids):
        if p is None:
            top = []
            for _, i in sorted(kids[t, c, None]):
                walk(t, c, i, None, top)
    return sorted(out, key=repr)


@pytest.mark.parametrize("group_rows", [10**6, 0])
def test_conditions_are_flattened_within_task_and_call(spark, group_rows):
    r = random.Random(4)
    nodes = {}
    for task in (1, 2, None):
        for call in (None, 1, 2):
            for i in range(25):
                parent = None if i == 0 or r.random() < 0.05 else r.randrange(max(0, i - 4), i)
                nodes[task, call, i] = (parent, i, r.choice([0, 1]))
    df = spark.createDataFrame([(t, c, i, *v, f"{t}.{c}.{i}") for (t, c, i), v in nodes.items()], "task_id int, call_id int, id int, parent_id int, position int, kind int, label string")
    got = T.flatten_conditions(df, group_rows)
    assert got.columns == df.columns
    assert rows(got, "task_id", "call_id", "id", "parent_id", "position", "kind") == flattened(nodes)
    assert all(x["label"] == f"{x['task_id']}.{x['call_id']}.{x['id']}" for x in got.collect())
    again = T.flatten_conditions(got.select(*df.columns), group_rows)
    assert rows(again) == rows(got)


def test_flattening_a_long_chain_writes_no_paths(spark):
    n = 1500
    df = spark.range(n).select(F.lit(1).alias("task_id"), F.lit(None).cast("int").alias("call_id"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"),
                               F.col("id").alias("position"), F.expr("id div 500 % 2").alias("kind"))
    folder = shared_folder(spark).removeprefix("file://")
    size = lambda: sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(folder) for x in names)
    before = size()
    got = T.flatten_conditions(df)
    assert rows(got, "id", "parent_id", "position", "kind") == [(0, None, 0, 0), (1000, 500, 0, 0), (500, 0, 0, 1)]
    assert size() - before < 12 << 20, size() - before  # paths of this chain have a million steps


def test_siblings_that_share_a_position_follow_by_their_paths(spark):
    nodes = [(1, None, 0, 0), (2, 1, 0, 0), (3, 1, 0, 0), (4, 2, 0, 1), (5, 2, 1, 1), (6, 3, 0, 1), (7, 3, 1, 1)]
    got = T.tree_flatten(spark.createDataFrame(nodes, "id long, parent_id long, position int, kind int"), "id", "parent_id", "position", "kind")
    place = {x["id"]: x["position"] for x in got.where("parent_id = 1").collect()}
    assert sorted(place) == [4, 5, 6, 7] and {place[4], place[6]} == {0, 1} and {place[5], place[7]} == {2, 3}

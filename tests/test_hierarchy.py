"""Hierarchies against walks in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import hierarchy as T
from tidemark.operators import reshape as R

S, P, A = T.SEQUENCE, T.PARALLEL, T.ATOM


def random_tree(n, seed, hot=False):
    """{id: (parent, position, kind)}; with ``hot`` a third of the nodes share one parent."""
    rnd = random.Random(seed)
    parent = {0: None}
    for i in range(1, n):
        parent[i] = 0 if hot and i % 3 == 0 else rnd.randrange(max(0, i - 6), i)
    kids = {i: [] for i in parent}
    for i, p in parent.items():
        if p is not None:
            kids[p].append(i)
    return {
        i: (p, 0 if p is None else kids[p].index(i), A if not kids[i] else rnd.choice([S, P])) for i, p in parent.items()
    }


def frame(spark, tree):
    return spark.createDataFrame([(i, *v) for i, v in tree.items()], "id bigint, parent_id bigint, position int, kind int")


def kids_of(tree):
    kids = {i: [] for i in tree}
    for i, (p, pos, _) in tree.items():
        if p is not None:
            kids[p].append((pos, i))
    return {i: [c for _, c in sorted(v)] for i, v in kids.items()}


def leaves(tree, kids, i, which):
    """First or last leaves of a subtree."""
    if not kids[i]:
        return [i]
    chosen = kids[i] if tree[i][2] == P else [kids[i][0 if which == "first" else -1]]
    return [x for c in chosen for x in leaves(tree, kids, c, which)]


TREES = [(1, 1, False), (60, 2, False), (200, 3, True)]


@pytest.mark.parametrize("n, seed, hot", TREES)
def test_paths(spark, n, seed, hot):
    tree = random_tree(n, seed, hot)

    def path(i):
        p, pos, _ = tree[i]
        return [pos] if p is None else [*path(p), pos]

    got = T.tree_paths(frame(spark, tree), "id", "parent_id", "position")
    assert rows(got, "id", "path", "depth") == sorted([(i, path(i), len(path(i)) - 1) for i in tree], key=repr)


def test_deep_chain(spark):
    chain = spark.range(700).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"), F.lit(0).alias("position"))
    got = T.tree_paths(chain, "id", "up", "position")
    assert got.where(F.col("depth") != F.col("id")).isEmpty() and got.count() == 700


def test_orphans_are_left_out_and_cycles_raise(spark):
    df = spark.createDataFrame([(1, None, 0), (2, 1, 0), (3, 99, 0), (4, 3, 0)], "id int, up int, position int")
    assert rows(T.tree_paths(df, "id", "up", "position"), "id") == [(1,), (2,)]
    loop = spark.createDataFrame([(1, None, 0), (2, 3, 0), (3, 2, 0)], "id int, up int, position int")
    with pytest.raises(ValueError, match="cycle"):
        T.root_paths(loop, "id", "up", F.col("position"))


@pytest.mark.parametrize("n, seed, hot", TREES)
def test_flatten(spark, n, seed, hot):
    tree = random_tree(n, seed, hot)
    kids = kids_of(tree)
    want = {}

    def walk(i, keeper):
        if i != keeper and tree[i][2] == tree[tree[i][0]][2]:
            pass  # merged: its children belong to the keeper
        elif i != keeper:
            want[keeper][1].append(i)
            want[i] = (keeper, [])
            keeper = i
        for c in kids[i]:
            walk(c, keeper)

    want[0] = (None, [])
    walk(0, 0)
    expected = sorted(
        [(i, up, 0 if up is None else want[up][1].index(i), tree[i][2]) for i, (up, _) in want.items()], key=repr
    )
    flat = T.tree_flatten(frame(spark, tree), "id", "parent_id", "position", "kind")
    assert rows(flat, "id", "parent_id", "position", "kind") == expected
    sliced = T.tree_flatten(frame(spark, tree), "id", "parent_id", "position", "kind", group_rows=0)
    assert rows(sliced, "id", "parent_id", "position", "kind") == expected
    again = T.tree_flatten(flat, "id", "parent_id", "position", "kind")
    assert rows(again, "id", "parent_id", "position", "kind") == expected


@pytest.mark.parametrize("n, seed, hot", TREES)
def test_edges_through_gates_are_the_direct_pairs(spark, n, seed, hot):
    tree = random_tree(n, seed, hot)
    kids = kids_of(tree)
    want = set()
    for i, (_, _, kind) in tree.items():
        if kind == S:
            for before, after in zip(kids[i], kids[i][1:], strict=False):
                want |= {(x, y) for x in leaves(tree, kids, before, "last") for y in leaves(tree, kids, after, "first")}
    edges = T.dependency_edges(frame(spark, tree), "id", "parent_id", "position", "kind").collect()
    into, out = {}, {}
    for e in edges:
        if e["src"].startswith("node"):
            into.setdefault(e["dst"], []).append(int(e["src"][5:]))
        else:
            out.setdefault(e["src"], []).append(int(e["dst"][5:]))
    assert {(x, y) for g in into for x in into[g] for y in out[g]} == want
    assert len(edges) <= 2 * sum(1 for i in tree if not kids[i])


@pytest.mark.parametrize("n, seed, hot", [(60, 2, False), (50, 3, True)])
def test_downstream_is_reachable(spark, n, seed, hot):
    tree = random_tree(n, seed, hot)
    df = frame(spark, tree)
    kids = kids_of(tree)
    start = min(leaves(tree, kids, 0, "first"))
    starts = spark.createDataFrame([(start,)], "id bigint")
    edges = T.dependency_edges(df, "id", "parent_id", "position", "kind")
    names = spark.createDataFrame([(f"node {start}",)], "node string")
    reach = {r["node"] for r in T.reachable(edges, names, "src", "dst").collect()}
    got = {f"node {r['id']}" for r in T.downstream_set(df, starts, "id", "parent_id", "position", "kind").collect()}
    assert got == {x for x in reach if x.startswith("node")}


def test_reachable_in_a_graph_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "a int, b int")
    starts = spark.createDataFrame([(1,)], "n int")
    assert rows(T.reachable(edges, starts, "a", "b")) == [(2, 1), (3, 2), (4, 3)]


def test_fold_and_relatives(spark):
    tree = random_tree(120, 8)
    kids = kids_of(tree)

    def total(i):
        return 1 if not kids[i] else sum(total(c) for c in kids[i])

    nodes = frame(spark, tree).select("id", "parent_id", F.when(F.col("kind") == A, 1).cast("bigint").alias("v"))
    got = T.bottom_up_fold(nodes, "id", "parent_id", "v", {"s": F.sum("v")}, F.col("s"))
    assert rows(got, "id", "v") == sorted([(i, total(i)) for i in tree], key=repr)

    def above(i):
        p = tree[i][0]
        return [] if p is None else [p, *above(p)]

    pairs = T.ancestors(frame(spark, tree), "id", "parent_id")
    assert rows(pairs, "id", "ancestor", "distance") == sorted(
        [(i, a, d) for i in tree for d, a in enumerate(above(i), start=1)], key=repr
    )
    below = T.descendants(frame(spark, tree), "id", "parent_id", 3)
    assert rows(below, "id", "distance") == sorted(
        [(i, above(i).index(3) + 1) for i in tree if 3 in above(i)], key=repr
    )


def test_inheritance_overrides_in_order(spark):
    df = spark.createDataFrame(
        [
            (1, None, {"a": "1", "b": "x"}, None),
            (2, 1, {"b": "${a}${b}"}, {"c": "${b}!", "d": "${nothing}"}),
            (3, 2, None, {"a": "2", "e": "${a}${c}"}),
        ],
        "id int, up int, call map<string,string>, task map<string,string>",
    )
    got = {r["id"]: r["f"] for r in T.inherit_attributes(df, "id", "up", ["call", "task"], "f").collect()}
    assert got[1] == {"a": "1", "b": "x"}
    assert got[2] == {"a": "1", "b": "1x", "c": "1x!", "d": ""}
    assert got[3] == {"a": "2", "b": "1x", "c": "1x!", "d": "", "e": "11x!"}


def test_two_level_expansion(spark):
    instances = spark.createDataFrame(
        [(1, None, None, 10, None), (2, 1, 1, 20, ["x"]), (3, 1, 2, 30, ["y", "z"]), (4, 2, 7, 30, ["y"])],
        "id bigint, parent_id bigint, call_id int, task_id int, identifier array<string>",
    )
    nodes = spark.createDataFrame(
        [(10, 1, None, 0, S, None), (10, 2, 1, 0, A, 1), (10, 3, 1, 1, A, 2), (20, 1, None, 0, A, 7)],
        "task_id int, id bigint, parent_id bigint, position int, kind int, call_id int",
    )
    names = spark.createDataFrame([(10, "main"), (20, "Load"), (30, "Copy")], "task_id int, name string")
    got = T.tree_two_level(instances, nodes, names, "main", {S: "sequence", P: "parallel"}).orderBy("path").collect()
    assert [(r["path"], r["node"]) for r in got] == [
        ([], "main"),
        ([0], "  sequence"),
        ([0, 0], "    Load x"),
        ([0, 0, 0], "      Copy y"),
        ([0, 1], "    Copy y z"),
    ]


@pytest.mark.parametrize(
    "template, want",
    [
        ("aaa${x}123", "aaatext123"),
        ("${x}${x}", "texttext"),
        ("no ${unknown}!", "no !"),
        ("plain", "plain"),
        ("${y} stays", "${x} stays"),
        ("", ""),
    ],
)
def test_render(spark, template, want):
    features = F.create_map(F.lit("x"), F.lit("text"), F.lit("y"), F.lit("${x}"))
    assert spark.range(1).select(R.render(template, features).alias("t")).first()["t"] == want


def test_empty_inputs(spark):
    nothing = spark.createDataFrame([], "id int, up int, position int, kind int")
    assert T.tree_paths(nothing, "id", "up", "position").isEmpty()
    assert T.tree_paths(nothing.where("false"), "id", "up", "position").isEmpty()
    assert T.tree_flatten(nothing, "id", "up", "position", "kind").isEmpty()
    assert T.dependency_edges(nothing, "id", "up", "position", "kind").isEmpty()
    assert T.bottom_up_fold(nothing, "id", "up", "kind", {"s": F.sum("kind")}, F.col("s")).isEmpty()
    maps = nothing.withColumn("m", F.create_map(F.lit("a"), F.lit("b")))
    assert T.inherit_attributes(maps, "id", "up", ["m"], "f").isEmpty()
    edges = spark.createDataFrame([], "a int, b int")
    assert T.reachable(edges, spark.createDataFrame([(1,)], "n int"), "a", "b").isEmpty()


def test_fan_out(spark):
    df = spark.createDataFrame([(1, list("abcde")), (2, []), (3, None)], "k int, l array<string>")
    assert rows(R.fan_out_list(df, ["k"], "l", ["p", "q"])) == [
        (1, 1, "a", "b"), (1, 2, "c", "d"), (1, 3, "e", None),
    ]

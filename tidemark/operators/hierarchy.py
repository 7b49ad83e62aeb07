"""Operators on adjacency lists.

Paths from the root come from path doubling: every round joins each unfinished
node to what is known of the ancestor it has reached, which doubles the distance
climbed.  A tree of depth d takes about log2(d) joins instead of d, and most later
questions (flattening, precedence, subtrees) are then answered inside the row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.contraction import Monoid, Sizes, contract
from tidemark.operators.intervals import join_in_blocks
from tidemark.operators.ordered import GROUP_ROWS, By, largest_group, row_number, running_sum
from tidemark.operators.projection import label_indented
from tidemark.operators.skew import lookup
from tidemark.session import add_piece, settle, settle_any

# Node kinds.
SEQUENCE, PARALLEL, ATOM = 0, 1, 2

def climb(nodes: DataFrame, key: Column, parent: Column, value: Column, join: Callable[[Column, Column], Column]) -> DataFrame:
    """(__k, __v): the values from the root down to each node, put together by ``join(upper, lower)``, which is associative.

    Nodes whose chain of parents breaks off are left out.  A round finishes or drops at least
    one node of every forest, however deep; one that does neither has only cycles left, and raises.
    """
    unfinished = F.col("__up").isNotNull()
    state, more = settle_any(nodes.select(key.alias("__k"), parent.alias("__up"), value.alias("__v")), unfinished)
    known = [state.where(~unfinished)]  # what begins at a root; written once, read from then on
    while more:
        before = more
        low = state.where(unfinished)
        high = reduce(DataFrame.unionByName, known, low).alias("high")
        low = low.alias("low")
        longer = low.join(high, F.col("low.__up") == F.col("high.__k")).select(
            F.col("low.__k").alias("__k"), F.col("high.__up").alias("__up"), join(F.col("high.__v"), F.col("low.__v")).alias("__v")
        )
        state, more = settle_any(longer, unfinished)
        if more == before:
            raise ValueError("the parents form a cycle")
        known = add_piece(known, state.where(~unfinished))
    return reduce(DataFrame.unionByName, known).select("__k", "__v")


def root_paths(
    nodes: DataFrame, key: str | Column, parent: str | Column, step: Column, name: str = "steps"
) -> DataFrame:
    """(key, array of ``step`` from the root down to the node); see ``climb``."""
    k = F.col(key) if isinstance(key, str) else key
    p = F.col(parent) if isinstance(parent, str) else parent
    paths = climb(nodes, k, p, F.array(step), lambda upper, lower: F.concat(upper, lower))
    return paths.select(F.col("__k").alias(key if isinstance(key, str) else "key"), F.col("__v").alias(name))


def tree_paths(nodes: DataFrame, key: str, parent: str, position: str) -> DataFrame:
    """Node, path of positions from the root, and depth (root = 0)."""
    paths = root_paths(nodes, key, parent, F.col(position), "path")
    return paths.withColumn("depth", F.size("path") - 1)


def ancestors(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(node, ancestor, distance) for all proper ancestors."""
    ids = root_paths(nodes, key, parent, F.col(key), "ids")
    up = ids.select(key, F.posexplode(F.reverse("ids")).alias("distance", "ancestor"))
    return up.where(F.col("distance") > 0)


def descendants(nodes: DataFrame, key: str, parent: str, of: int) -> DataFrame:
    """The subtree below one node, with the distance to it.

    Breadth first from the node down, so the rest of the forest is only joined to, never climbed.
    """
    start = nodes.where(F.col(key) == of).select(F.col(key))
    below = nodes.select(F.col(parent).alias("__from"), F.col(key).alias("__to")).where(F.col("__from").isNotNull())
    return reachable(below, start, "__from", "__to")


def predecessors(edges: DataFrame, starts: DataFrame, src: str, dst: str) -> DataFrame:
    """Nodes from which the starts are reached along directed edges, with the number of steps: ``reachable`` backwards."""
    return reachable(edges, starts, dst, src)


def placed_among_siblings(nodes: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``nodes`` (__key, __up, __among, __p) with __size, the nodes in the subtree, and __off: 1 and the sizes of the siblings before.

    The sum of __off from the root down to a node is its number in pre-order.  Siblings, which share ``__among``, follow by
    position, NULL first, and then by key.  Keys must be unique; nodes whose chain of parents breaks off count nowhere else.
    """
    sized = settle(contract(nodes.withColumn("__size", F.lit(1).cast("bigint")), "__key", "__up", "__size", Sizes()))
    upto = running_sum(sized, ["__among"], [By("__p", nulls_first=True), "__key"], "__size", "__upto", group_rows)
    return upto.withColumn("__off", F.col("__upto") - F.col("__size") + 1).drop("__upto")


def tree_flatten(
    nodes: DataFrame, key: str, parent: str, position: str, kind: str, group_rows: int = GROUP_ROWS, forest: Sequence[str] = ()
) -> DataFrame:
    """Merge a node into its parent when both are of one kind.

    Children of a merged node move to the nearest node that stays, numbered from 0
    in the order of their paths.  With ``forest``, keys count within one combination of its columns,
    where NULL is a value like any other; parents are looked for there, and roots are numbered there.

    Paths are compared by pre-order numbers, so a node costs the same at any depth.  Only where a key occurs twice or
    siblings share a position, in which case the order of paths is not that of a walk, whole paths are built.
    """
    of = [F.col(c) for c in forest]
    among = F.struct(*of, F.col(parent).alias("id"))
    own = settle(nodes.select(
        F.struct(*of, F.col(key).alias("id")).alias("__key"), F.when(F.col(parent).isNotNull(), among).alias("__up"), among.alias("__among"),
        F.col(position).cast("bigint").alias("__p"), F.col(kind).alias("__kind")))
    if largest_group(own, ["__key"]) > 1 or largest_group(own.where(F.col("__up").isNotNull()), ["__up", "__p"]) > 1:
        return _flatten_by_paths(nodes, key, parent, position, kind, group_rows, forest)
    kinds = own.select(F.col("__key").alias("__pk"), F.col("__kind").alias("__above"))
    joined = placed_among_siblings(own, group_rows).join(kinds, F.col("__up") == F.col("__pk"), "left")
    stays = F.col("__up").isNull() | F.coalesce(F.col("__kind") != F.col("__above"), F.lit(False))
    # near: the last node that stays; above: the last one before the end of the stretch
    value = F.struct(
        F.col("__off").alias("n"), F.when(stays, F.col("__key.id")).alias("near"), F.lit(None).cast(nodes.schema[key].dataType).alias("above"),
        F.col("__kind").alias("kind"), stays.alias("stays"))
    walked = climb(joined, F.col("__key"), F.col("__up"), value, lambda upper, lower: F.struct(
        (upper["n"] + lower["n"]).alias("n"), F.coalesce(lower["near"], upper["near"]).alias("near"),
        F.coalesce(lower["above"], upper["near"]).alias("above"), lower["kind"].alias("kind"), lower["stays"].alias("stays")))
    kept = walked.where("__v.stays").select(
        *[F.col("__k")[c].alias(c) for c in forest], F.col("__k.id").alias(key), F.col("__v.above").alias(parent), F.col("__v.kind").alias(kind), F.col("__v.n").alias("__at"))
    numbered = row_number(kept, [*forest, parent], ["__at"], "__n", group_rows)
    return numbered.select(*forest, key, parent, (F.col("__n") - 1).alias(position), kind)


def _flatten_by_paths(nodes: DataFrame, key: str, parent: str, position: str, kind: str, group_rows: int, forest: Sequence[str]) -> DataFrame:
    """``tree_flatten`` for any keys and positions, with the whole path in each row."""
    of = [F.col(c) for c in forest]
    # Equality of structs takes two NULL parts as equal, as a condition on each part would not
    here = F.struct(*of, F.col(key).alias("id")) if forest else F.col(key)
    above_here = F.when(F.col(parent).isNotNull(), F.struct(*of, F.col(parent).alias("id"))) if forest else F.col(parent)
    step = F.struct(F.col(key).alias("id"), F.col(kind).alias("kind"), F.col(position).cast("bigint").alias("position"))
    steps = root_paths(nodes, here, above_here, step)
    own = F.col("key")
    last, above = F.element_at("steps", -1), F.try_element_at("steps", F.lit(-2))
    stays = F.size("steps") == 1
    stays = stays | (last["kind"] != above["kind"])
    upper = F.slice("steps", 1, F.size("steps") - 1)
    kept_upper = F.filter(upper, lambda s, i: (i == 0) | (s["kind"] != F.get("steps", i - 1)["kind"]))
    kept = steps.where(stays).select(
        *[own[c].alias(c) for c in forest],
        last["id"].alias(key),
        F.try_element_at(kept_upper, F.lit(-1))["id"].alias(parent),
        last["kind"].alias(kind),
        F.transform("steps", lambda s: s["position"]).alias("__path"),
    )
    numbered = row_number(kept, [*forest, parent], ["__path"], "__n", group_rows)
    return numbered.select(*forest, key, parent, (F.col("__n") - 1).alias(position), kind)


def flatten_conditions(nodes: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Condition trees with nodes of one connective merged: one forest per (task_id, call_id), where call_id may be NULL.

    ``nodes``: task_id, call_id, id, parent_id, position, kind and any others, which nodes that stay keep.
    """
    forest = ["task_id", "call_id"]
    flat = tree_flatten(nodes, "id", "parent_id", "position", "kind", group_rows, forest)
    rest = nodes.drop("parent_id", "position", "kind").withColumnsRenamed({c: f"__{c}" for c in [*forest, "id"]})
    same = F.col("task_id").eqNullSafe(F.col("__task_id")) & F.col("call_id").eqNullSafe(F.col("__call_id")) & (F.col("id") == F.col("__id"))
    return flat.join(rest, same).select(*nodes.columns)


def precedence_steps(nodes: DataFrame, key: str, parent: str, position: str, kind: str) -> DataFrame:
    """Leaves with the steps from the root, each step knowing the last position among its children."""
    kids = nodes.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("__p")).agg(F.max(position).alias("__last"))
    with_kids = nodes.join(kids, F.col(key) == F.col("__p"), "left")
    step = F.struct(
        F.col(key).alias("id"), F.col(kind).alias("kind"), F.col(position).cast("bigint").alias("position"),
        F.col("__last").cast("bigint").alias("last_child"),
    )
    steps = root_paths(with_kids, key, parent, step)
    return steps.where(F.element_at("steps", -1)["last_child"].isNull())


def _edges_down() -> Column:
    """Per step below the root: its parent, the parent's kind and last child, its own position."""
    return F.transform(
        F.sequence(F.lit(0), F.size("steps") - 2),
        lambda i: F.struct(
            F.get("steps", i)["id"].alias("id"),
            (F.get("steps", i)["kind"] == SEQUENCE).alias("ordered"),
            F.get("steps", i)["last_child"].alias("last_child"),
            F.get("steps", i + 1)["position"].alias("position"),
        ),
    )


def leaf_gates(nodes: DataFrame, key: str, parent: str, position: str, kind: str) -> DataFrame:
    """For every leaf the gate it waits for and the gate it opens.

    A gate is a place between two neighbours in a sequence: (sequence node, position
    of the later one).  A leaf starts when the deepest step into a later member of a
    sequence allows it, and it holds up the deepest step out of a member that is not
    the last.  Positions must be dense from 0, as ``tree_flatten`` leaves them.
    """
    leaves = precedence_steps(nodes, key, parent, position, kind).where(F.size("steps") > 1)
    edges = leaves.select(key, _edges_down().alias("edges"))
    before = F.try_element_at(F.filter("edges", lambda e: e["ordered"] & (e["position"] > 0)), F.lit(-1))
    after = F.try_element_at(F.filter("edges", lambda e: e["ordered"] & (e["position"] < e["last_child"])), F.lit(-1))
    gate = lambda e, shift: F.when(
        e.isNotNull(), F.struct(e["id"].alias("id"), (e["position"] + shift).alias("position"))
    )
    return edges.select(key, gate(before, 0).alias("waits_for"), gate(after, 1).alias("opens"))


def dependency_edges(nodes: DataFrame, key: str, parent: str, position: str, kind: str) -> DataFrame:
    """Precedence among leaves as edges leaf -> gate -> leaf.

    Two neighbours with m last and n first leaves give m + n edges through their gate;
    the m * n direct pairs are the join of the two halves on the gate.
    """
    gates = leaf_gates(nodes, key, parent, position, kind)
    node = F.concat(F.lit("node "), F.col(key).cast("string"))
    name = lambda g: F.concat(F.lit("gate "), F.col(f"{g}.id").cast("string"), F.lit("."), F.col(f"{g}.position").cast("string"))
    into = gates.where(F.col("opens").isNotNull()).select(node.alias("src"), name("opens").alias("dst"))
    out = gates.where(F.col("waits_for").isNotNull()).select(name("waits_for").alias("src"), node.alias("dst"))
    return into.unionByName(out)


def downstream_set(nodes: DataFrame, starts: DataFrame, key: str, parent: str, position: str, kind: str) -> DataFrame:
    """All leaves that come after the given leaves: what a reload of those has to redo.

    A leaf comes after a start when the two part below a sequence, the start earlier.
    Only the earliest start position per sequence counts, so each leaf meets one row.
    """
    leaves = settle(precedence_steps(nodes, key, parent, position, kind).where(F.size("steps") > 1))
    edges = leaves.select(key, F.explode(_edges_down()).alias("e")).where(F.col("e.ordered"))
    edges = edges.select(key, F.col("e.id").alias("__seq"), F.col("e.position").alias("__at"))
    given = edges.join(starts.select(key).distinct(), key, "left_semi")
    first = given.groupBy("__seq").agg(F.min("__at").alias("__from"))
    # A sequence near the root has most leaves below it: a hot key.
    after = lookup(edges, first, {"__seq": "__seq"}, ["__from"], "inner").where(F.col("__at") > F.col("__from"))
    return after.select(key).distinct()


def labels(nodes: DataFrame, key: str, parent: str, position: str) -> DataFrame:
    """(key, first, last): nodes numbered in pre-order over the whole forest, and the last number in each one's subtree.

    One node lies below another exactly if its number is within the other's.  Siblings follow by position, then key.
    Numbers are sums of the sizes of subtrees; only where a key occurs twice they come from whole paths.
    """
    own = settle(nodes.where(F.col(key).isNotNull()).select(
        F.col(key).alias("__key"), F.col(parent).alias("__up"), F.col(parent).alias("__among"), F.col(position).alias("__p")))
    if largest_group(own, ["__key"]) > 1:
        return _labels_by_paths(nodes, key, parent, position)
    value = F.struct(F.col("__off").alias("n"), F.col("__size").alias("size"))
    walked = climb(placed_among_siblings(own), F.col("__key"), F.col("__up"), value, lambda upper, lower: F.struct(
        (upper["n"] + lower["n"]).alias("n"), lower["size"].alias("size")))
    return walked.select(F.col("__k").alias(key), F.col("__v.n").alias("first"), (F.col("__v.n") + F.col("__v.size") - 1).alias("last"))


def _labels_by_paths(nodes: DataFrame, key: str, parent: str, position: str) -> DataFrame:
    """``labels`` for keys that may occur twice."""
    paths = root_paths(nodes, key, parent, F.struct(F.col(position).alias("p"), F.col(key).alias("k")), "__path")
    numbered = row_number(paths, [], ["__path"], "first").select(F.col(key).alias("__k"), "first")
    placed = nodes.select(key, parent).join(numbered, F.col(key) == F.col("__k")).select(key, parent, "first", F.col("first").alias("last"))
    # The last number below a node is the largest of its children's; a leaf has its own
    return contract(settle(placed), key, parent, "last", Monoid("max")).select(key, "first", "last")


def descendants_of_each(nodes: DataFrame, starts: DataFrame, key: str, parent: str, position: str) -> DataFrame:
    """(start, key) for everything below each of many starts: one join of numbers to subtrees, see ``labels``."""
    marked = settle(labels(nodes, key, parent, position))
    below = starts.select(F.col(key).alias("start")).distinct().join(marked, F.col("start") == F.col(key)).select("start", F.col("first").alias("__from"), F.col("last").alias("__to"))
    points = marked.select(key, "first")
    return join_in_blocks(points, below, {}, F.col("first"), F.col("__from") + 1, F.col("__to") + 1).select("start", key)


def downstream_of_each(nodes: DataFrame, starts: DataFrame, key: str, parent: str, position: str, kind: str) -> DataFrame:
    """(start, key): for each of many starting leaves all leaves that come after it, as ``downstream_set`` gives for all at once.

    Where a start lies below a sequence, what follows it there is what is numbered behind the member it lies in, up to
    the end of the sequence: one interval of pre-order numbers.  So there is one join, and no pass per start.
    """
    marked = settle(labels(nodes, key, parent, position))
    leaves = settle(precedence_steps(nodes, key, parent, position, kind).where(F.size("steps") > 1))
    given = starts.select(F.col(key).alias("start")).distinct()
    steps = leaves.join(given, F.col(key) == F.col("start")).select("start", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("steps") - 2),
        lambda i: F.struct(F.get("steps", i)["id"].alias("seq"), F.get("steps", i)["kind"].alias("kind"), F.get("steps", i + 1)["id"].alias("member")))).alias("e"))
    steps = steps.where(F.col("e.kind") == SEQUENCE).select("start", "e.seq", "e.member")
    of_seq = marked.select(F.col(key).alias("__s"), F.col("last").alias("__to"))
    of_member = marked.select(F.col(key).alias("__m"), F.col("last").alias("__done"))
    after = steps.join(of_seq, F.col("seq") == F.col("__s")).join(of_member, F.col("member") == F.col("__m")).select("start", "__done", "__to")
    points = leaves.select(F.col(key).alias("__l")).join(marked, F.col("__l") == F.col(key)).select(key, "first")
    return join_in_blocks(points, after, {}, F.col("first"), F.col("__done") + 1, F.col("__to") + 1).select("start", key)


def reachable(edges: DataFrame, starts: DataFrame, src: str, dst: str) -> DataFrame:
    """Nodes reached from the starts along directed edges, with the number of steps.

    Breadth first: each round joins only the nodes found by the one before, and ends when it
    finds none, cycles or not.  The edges are read in every round, so they are derived once.
    """
    name = starts.columns[0]
    edges = settle(edges.select(src, dst).distinct())
    front = settle(starts.distinct().withColumn("distance", F.lit(0)))
    found = front
    for distance in count(1):
        nxt = front.join(edges, F.col(name) == F.col(src)).select(F.col(dst).alias(name)).distinct()
        front, more = settle_any(nxt.join(found, name, "left_anti").withColumn("distance", F.lit(distance)), F.lit(True))
        if not more:
            return found.where(F.col("distance") > 0)
        found = found.unionByName(front)
        if distance % 16 == 0:
            found = settle(found)  # keeps the plan short


def tree_two_level(
    instances: DataFrame, nodes: DataFrame, names: DataFrame, main: str, kinds: dict[int, str]
) -> DataFrame:
    """Expand instances through the node tree of their task, labelled and in pre-order.

    ``instances``: id, parent_id, call_id, task_id, identifier; ``nodes``: task_id, id,
    parent_id, position, kind, call_id; ``names``: task_id, name.  A node's parent is
    another node of the same instance, or, for the top node of a called task, the
    calling atom one instance up.  That makes one adjacency list out of two.
    """
    inst = instances.select(
        F.col("id").alias("i_id"), F.col("parent_id").alias("i_up"), F.col("call_id").alias("i_call"), "task_id"
    )
    own = nodes.select(
        "task_id", F.col("id").alias("n_id"), F.col("parent_id").alias("n_up"), "position", "kind",
        F.col("call_id").alias("n_call"),
    )
    rows = settle(inst.join(own, "task_id"))
    callers = rows.where(F.col("n_call").isNotNull()).select(
        F.col("i_id").alias("c_inst"), F.col("n_call").alias("c_call"), F.col("n_id").alias("c_node")
    )
    linked = rows.join(
        callers,
        F.col("n_up").isNull() & (F.col("i_up") == F.col("c_inst")) & (F.col("i_call") == F.col("c_call")),
        "left",
    )
    here = F.struct(F.col("i_id").alias("i"), F.col("n_id").alias("n"))
    up = F.when(F.col("n_up").isNotNull(), F.struct(F.col("i_id").alias("i"), F.col("n_up").alias("n"))).when(
        F.col("c_node").isNotNull(), F.struct(F.col("c_inst").alias("i"), F.col("c_node").alias("n"))
    )
    # A top node whose caller is missing hangs below an unknown parent and is left out.
    up = F.when(F.col("n_up").isNull() & F.col("i_up").isNotNull() & F.col("c_node").isNull(),
                F.struct(F.col("i_up").alias("i"), F.lit(-1).cast("bigint").alias("n"))).otherwise(up)
    adjacency = linked.select(here.alias("key"), up.alias("up"), "position", "kind", "n_call")
    paths = root_paths(adjacency, "key", "up", F.col("position"), "path")
    called = instances.join(names, "task_id").select(
        F.col("parent_id").alias("d_up"), F.col("call_id").alias("d_call"), "name", "identifier"
    )
    full = paths.join(adjacency.drop("up", "position"), "key")
    full = full.join(called, (F.col("key.i") == F.col("d_up")) & (F.col("n_call") == F.col("d_call")), "left")
    code = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    indent = F.repeat(F.lit(" "), 2 * F.size("path"))
    label = F.when(F.col("kind") == ATOM, label_indented("path", "name", "identifier")).otherwise(
        F.concat(indent, F.try_element_at(code, F.col("kind")))
    )
    top = instances.sparkSession.range(1).select(F.array().cast(full.schema["path"].dataType).alias("path"), F.lit(main).alias("node"))
    return full.select("path", label.alias("node")).unionByName(top)


def bottom_up_fold(
    nodes: DataFrame, key: str, parent: str, value: str, over: dict[str, Column], finish: Column
) -> DataFrame:
    """Evaluate inner nodes from their children, up to the roots, with any aggregates.

    ``over`` names aggregates of the children's ``value``; ``finish`` combines them
    with the node's own columns.  A node without children keeps its value.  Children
    are combined before the shuffle, so a parent with very many of them is no burden; but there are as many
    rounds as a tree is high.  ``contraction.contract`` needs few, for sums, least and greatest.
    """
    parents = nodes.where(F.col(parent).isNotNull()).select(F.col(parent).alias("__p")).distinct()
    waiting = settle(nodes.join(parents, F.col(key) == F.col("__p"), "left_semi"))
    known = settle(nodes.join(parents, F.col(key) == F.col("__p"), "left_anti"))
    done, ahead = [known], known.where(F.col(parent).isNotNull())
    while not waiting.isEmpty():
        open_ = waiting.where(F.col(parent).isNotNull()).select(F.col(parent).alias("__o")).distinct()
        told = ahead.join(open_, F.col(parent) == F.col("__o"), "left_anti")
        folded = told.groupBy(F.col(parent).alias("__p")).agg(*[c.alias(n) for n, c in over.items()])
        new = settle(waiting.join(folded, F.col(key) == F.col("__p")).withColumn(value, finish.cast(nodes.schema[value].dataType)).select(*nodes.columns))
        if new.isEmpty():
            raise ValueError("the parents form a cycle")
        found = new.select(F.col(key).alias("__f"))
        waiting = settle(waiting.join(found, F.col(key) == F.col("__f"), "left_anti"))
        ahead = settle(ahead.join(found, F.col(parent) == F.col("__f"), "left_anti").unionByName(new.where(F.col(parent).isNotNull())))
        done.append(new)
    return reduce(DataFrame.unionByName, done)


def merged_map(base: Column, over: Column) -> Column:
    """Union of two maps; ``over`` wins."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def _parsed(template: Column) -> Column:
    """A text with ``${name}`` as an array of (text, name): text as it stands, or a name to be replaced.

    It begins with a text; a NULL is one part with neither.
    """
    part = lambda text, name: F.struct(text.cast("string").alias("text"), name.cast("string").alias("name"))
    none = F.lit(None)

    def piece(p: Column) -> Column:
        name = F.substring_index(p, "}", 1)
        tail = F.when(F.locate("}", p) > 0, p.substr(F.length(name) + 2, F.length(p))).otherwise(F.lit(""))
        return F.array(part(none, name), part(tail, none))

    pieces = F.split(template, r"\$\{")
    rest = F.flatten(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), piece))
    return F.when(template.isNull(), F.array(part(none, none))).otherwise(F.concat(F.array(part(F.element_at(pieces, 1), none)), rest))


def _replaced(parts: Column, known: Column) -> Column:
    """Parts with the names that ``known`` has replaced by what it says; neighbouring texts become one."""
    put = F.flatten(F.transform(parts, lambda p: F.when(p["name"].isNotNull(), F.coalesce(F.try_element_at(known, p["name"]), F.array(p))).otherwise(F.array(p))))

    def add(out: Column, p: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        both = (F.size(out) > 0) & last["name"].isNull() & p["name"].isNull()
        text = F.concat(F.coalesce(last["text"], F.lit("")), F.coalesce(p["text"], F.lit("")))
        one = F.struct(text.alias("text"), F.lit(None).cast("string").alias("name"))
        return F.when(both, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(one))).otherwise(F.concat(out, F.array(p)))

    return F.aggregate(put, F.array().cast("array<struct<text:string,name:string>>"), add)


def inherit_attributes(nodes: DataFrame, key: str, parent: str, layers: Sequence[str], name: str) -> DataFrame:
    """Effective attributes: the parent's, overridden by each layer of the node in turn.

    Values of a layer may use ``${x}`` for anything known so far; what nothing above knows is empty.  A node is a
    function of its parent's attributes: a map of values in which names from above are still open.  Two such
    functions are put together by filling in, so the effective ones come from ``climb``, in about log2(depth) joins.
    """
    empty = F.create_map().cast("map<string,array<struct<text:string,name:string>>>")
    texts = F.create_map().cast("map<string,string>")

    def over(lower: Column, upper: Column) -> Column:
        return merged_map(upper, F.transform_values(lower, lambda _, parts: _replaced(parts, upper)))

    own = empty
    for layer in layers:
        own = over(F.transform_values(F.coalesce(F.col(layer), texts), lambda _, v: _parsed(v)), own)

    def said(parts: Column) -> Column:
        nothing = (F.size(parts) == 1) & F.get(parts, 0)["text"].isNull() & F.get(parts, 0)["name"].isNull()
        return F.when(~nothing, F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""))

    found = climb(nodes, F.col(key), F.col(parent), own, lambda upper, lower: over(lower, upper))
    found = found.select("__k", F.transform_values("__v", lambda _, parts: said(parts)).alias("__v"))
    return nodes.join(found, F.col(key) == F.col("__k")).select(*nodes.columns, F.col("__v").alias(name))

"""Folding trees from the leaves up in a number of rounds that grows with the logarithm of their size.

Going level by level takes as many rounds as a tree is deep.  Here every round does two things to all trees at once.
Nodes all of whose children are known get their value, and hand it to their parents: that removes the leaves, however
many one parent has.  A node with one unknown child left has become a function of that child's value; it looks through
the child if that is such a function too, and composes the two, so along a chain each looks twice as far as before.

For that a node's remaining function must be a small value itself.  ``Monoid`` covers sums, minima and maxima, where it is
what the known children add up to; ``Levels`` covers values 1 to n folded by least and greatest, like and, or and not,
where it is the list of its results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import add_piece, settle_any


@dataclass(frozen=True)
class Monoid:
    """A node with children is the ``sum``, ``min`` or ``max`` of their values; NULLs count for nothing."""

    op: str

    def spec(self) -> Column:
        return F.lit(True)

    def gather(self, value: Column) -> Column:
        return getattr(F, self.op)(value)

    def merge(self, a: Column, b: Column) -> Column:
        if self.op == "sum":
            return F.coalesce(a + b, a, b)
        return F.least(a, b) if self.op == "min" else F.greatest(a, b)

    def close(self, spec: Column, known: Column) -> Column:
        return known

    def opened(self, spec: Column, known: Column) -> Column:
        return known

    def apply(self, function: Column, value: Column) -> Column:
        return self.merge(function, value)

    def compose(self, outer: Column, inner: Column) -> Column:
        return self.merge(outer, inner)


@dataclass(frozen=True)
class Sizes(Monoid):
    """A node is the number of nodes in its subtree, itself included; leaves must have 1."""

    op: str = "sum"

    def close(self, spec: Column, known: Column) -> Column:
        return F.coalesce(known, F.lit(0)) + F.lit(1)

    opened = close


@dataclass(frozen=True)
class Levels:
    """Values 1 to ``n`` or NULL; a node with children is ``finish(least, greatest)`` of theirs, NULLs left out.

    ``finish`` may use columns of the node.  A function is the array of its results for NULL, 1, .. n.
    """

    n: int
    finish: Callable[[Column, Column], Column]

    def _all(self) -> list[Column]:
        return [F.lit(i if i else None).cast("int") for i in range(self.n + 1)]

    def spec(self) -> Column:
        # Results by least and greatest: all that is ever needed of the node's own columns
        return F.array(*[F.array(*[self.finish(a, b).cast("int") for b in self._all()]) for a in self._all()])

    def gather(self, value: Column) -> Column:
        return F.struct(F.min(value).cast("int").alias("a"), F.max(value).cast("int").alias("b"))

    def merge(self, a: Column, b: Column) -> Column:
        return F.struct(F.least(a["a"], b["a"]).alias("a"), F.greatest(a["b"], b["b"]).alias("b"))

    def close(self, spec: Column, known: Column) -> Column:
        return F.get(F.get(spec, F.coalesce(known["a"], F.lit(0))), F.coalesce(known["b"], F.lit(0)))

    def opened(self, spec: Column, known: Column) -> Column:
        return F.array(*[self.close(spec, self.merge(known, F.struct(x.alias("a"), x.alias("b")))) for x in self._all()])

    def apply(self, function: Column, value: Column) -> Column:
        return F.get(function, F.coalesce(value, F.lit(0)))

    def compose(self, outer: Column, inner: Column) -> Column:
        return F.transform(inner, lambda x: F.get(outer, F.coalesce(x, F.lit(0))))


def contract(nodes: DataFrame, key: str, parent: str, value: str, fold: Monoid | Levels) -> DataFrame:
    """``nodes`` with ``value`` replaced, in nodes that have children, by the fold of their values; leaves keep theirs.

    A node whose parent is missing or not in the table is the root of a tree of its own, and is folded like one.  Keys
    must be unique and not NULL; parents that form a cycle raise.  Each round joins twice by key and is written to the shared
    folder once.  The number of rounds follows the logarithm of the number of nodes, for a chain as for a star: what is known
    of children is combined before it is shuffled, so a parent may have any number of them.
    """
    own = nodes.select(F.col(key).alias("k"), F.col(parent).alias("up"), F.col(value).alias("own"), fold.spec().alias("spec"))
    parents = own.where(F.col("up").isNotNull()).select(F.col("up").alias("p")).distinct().withColumn("inner", F.lit(True))
    start = own.join(parents, F.col("k") == F.col("p"), "left").drop("p")
    got_type = start.groupBy("k").agg(fold.gather(F.col("own")).alias("g")).schema["g"].dataType
    nothing = F.lit(None).cast(got_type)
    types = start.select(fold.close(F.col("spec"), nothing).alias("v"), fold.opened(F.col("spec"), nothing).alias("f")).schema
    said = lambda v: F.struct(v.cast(types["v"].dataType).alias("v"))  # noqa: E731  - a value of NULL is known too
    unknown = F.col("known").isNull()
    # below: the node that this one looks at, all whose value its own depends on, by the function fn
    state = start.select(
        "k", "up", "spec", nothing.alias("got"), F.lit(None).cast(start.schema["k"].dataType).alias("below"),
        F.lit(None).cast(types["f"].dataType).alias("fn"), F.when(F.col("inner").isNull(), said(F.col("own"))).alias("known"))
    state, more = settle_any(state, unknown)
    # The expressions of a round, built once
    news = [fold.gather(F.col("known.v")).alias("new"), F.count_if(unknown).alias("open"), F.min(F.when(unknown, F.col("k"))).alias("child")]
    seen = [F.col("k").alias("bk"), F.col("below").alias("next"), F.col("fn").alias("inner"), F.col("known").alias("found")]
    joint = F.when(F.col("got").isNull(), F.col("new")).when(F.col("new").isNull(), F.col("got")).otherwise(fold.merge(F.col("got"), F.col("new")))
    looks, one = F.col("below").isNotNull(), F.col("open") == 1
    step = [
        F.col("k"), F.col("up"), F.col("spec"), F.col("got"),
        F.when(looks, F.coalesce("next", "below")).when(one, F.col("child")).alias("below"),
        F.when(looks & F.col("next").isNotNull(), fold.compose(F.col("fn"), F.col("inner"))).when(looks, F.col("fn"))
        .when(one, fold.opened(F.col("spec"), F.col("got"))).alias("fn"),
        F.when(F.coalesce("open", F.lit(0)) == 0, said(fold.close(F.col("spec"), F.col("got"))))
        .when(F.col("found").isNotNull(), said(fold.apply(F.col("fn"), F.col("found.v")))).alias("known"),
    ]
    # What a node that is known depends on is of no use any more
    finished = lambda: state.where(~unknown).select("k", "known")
    done = [finished()]
    while more:
        before = more
        # Nodes known since the last round tell their parents; those still unknown are counted
        told = state.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("p")).agg(*news)
        at = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), done, state.where(unknown).select("k", "below", "fn", "known")).select(*seen)
        joined = state.where(unknown).join(told, F.col("k") == F.col("p"), "left").join(at, F.col("below") == F.col("bk"), "left")
        state, more = settle_any(joined.withColumn("got", joint).select(*step), unknown)
        if more == before:
            raise ValueError("the parents form a cycle")
        done = add_piece(done, finished())
    values = reduce(DataFrame.unionByName, done).select(F.col("k").alias("__k"), F.col("known.v").cast(nodes.schema[value].dataType).alias("__v"))
    return nodes.join(values, F.col(key) == F.col("__k")).select(*[F.col("__v").alias(value) if c == value else F.col(c) for c in nodes.columns])

"""Joining points to the intervals that hold them, without testing every pair of a key.

A range condition alone compares each row of a key with all intervals of that key.  Here every interval is cut into
blocks whose sizes are powers of four and which lie at multiples of their size, a few for each size.  A point lies in one
block of each size, so it meets its intervals by equality of (key, size, block), and meets each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.predicates import all_of
from tidemark.session import settle

#: Sizes of blocks are 4**0 .. 4**LEVELS units.
LEVELS = 30


def cover(first: Column, end: Column) -> Column:
    """Blocks (level, block) that make up the whole numbers from ``first`` on and below ``end``."""
    blocks = "array<struct<level:int,block:bigint>>"
    none = F.array().cast(blocks)

    def run(level: Column, lo: Column, hi: Column) -> Column:
        made = F.transform(F.sequence(lo, hi - 1), lambda b: F.struct(level.alias("level"), b.alias("block")))
        return F.when(lo < hi, made).otherwise(none)

    def step(acc: Column, level: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        up, down = F.shiftright(lo + 3, 2), F.shiftright(hi, 2)
        # What is left over on both sides, or all that remains
        split = (up < down) & (level < LEVELS)
        left, right = run(level, lo, F.when(split, 4 * up).otherwise(hi)), run(level, F.when(split, 4 * down).otherwise(hi), hi)
        return F.struct(F.when(split, up).otherwise(hi).cast("bigint").alias("lo"), F.when(split, down).otherwise(hi).cast("bigint").alias("hi"),
                        F.concat(acc["out"], left, right).alias("out"))

    start = F.struct(first.cast("bigint").alias("lo"), end.cast("bigint").alias("hi"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step)["out"]


def join_in_blocks(
    points: DataFrame, intervals: DataFrame, on: dict[str, str], at: Column, first: Column, end: Column, exact: Column | None = None
) -> DataFrame:
    """Pairs of a point and an interval with equal keys and ``first`` <= ``at`` < ``end``, all whole numbers.

    ``on`` maps key columns of the points to those of the intervals, and no other column names may be shared.  NULLs match
    nothing and an empty interval holds nothing.  ``exact`` is tested on the pairs found, for callers whose
    numbers are rounded outward.  Only sizes of blocks that occur are looked for, so points multiply by those.
    """
    known = intervals.where(first.isNotNull() & end.isNotNull() & all_of(F.col(c).isNotNull() for c in on.values()))
    cut = settle(known.select("*", F.explode(cover(first, end)).alias("__b")).select("*", "__b.level", "__b.block").drop("__b")
                 .withColumnsRenamed({"level": "__level", "block": "__block"}))
    levels = sorted(r["__level"] for r in cut.select("__level").distinct().collect())
    probe = F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright(at.cast("bigint"), 2 * i).alias("block")) for i in levels])
    if not levels:
        probe = F.array().cast("array<struct<level:int,block:bigint>>")
    probes = points.where(at.isNotNull()).select("*", F.explode(probe).alias("__p"))
    keys = all_of(F.col(a) == F.col(b) for a, b in on.items())
    found = probes.join(cut, keys & (F.col("__p.level") == F.col("__level")) & (F.col("__p.block") == F.col("__block")))
    if exact is not None:
        found = found.where(exact)
    return found.select(*points.columns, *intervals.columns)


def join_versions(
    rows: DataFrame, versions: DataFrame, on: dict[str, str], at: str, start: str = "start_ts", end: str = "end_ts", unit: int = 86_400
) -> DataFrame:
    """Rows with the versions of their key that were valid at the row's own time: ``start <= at < end``.

    For keys with very many versions, or versions that overlap; ``join_version_range`` does for few.  Blocks count
    ``unit`` seconds, rounded outward, so only versions valid some time in the same unit are tested pair by pair.
    """
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    before_end = F.floor((seconds(end) + F.lit(unit)) / F.lit(unit))
    full = F.when(F.col(start) < F.col(end), before_end)
    return join_in_blocks(rows, versions, on, F.floor(seconds(at) / F.lit(unit)), F.floor(seconds(start) / F.lit(unit)), full, inside)

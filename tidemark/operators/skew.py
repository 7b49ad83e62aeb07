"""Joining rows to a table with one row per key when some keys are very frequent.

Adaptive execution splits skewed partitions only where a join reads both sides
straight from a shuffle.  A lookup table that was just aggregated does not qualify.  So rows with a frequent key
are not shuffled at all: there are few such keys, and the rows looked up for them are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

HOT_ROWS = 4_000_000


def same_keys(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    """Equal or both NULL on every pair of columns."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs.items()], F.lit(True))


def lookup(
    left: DataFrame, right: DataFrame, on: dict[str, str], columns: Sequence[str], how: str = "left", hot_rows: int = HOT_ROWS,
    hot: Sequence[Row] | None = None,
) -> DataFrame:
    """``left`` with ``columns`` of the one ``right`` row that has its key, NULL keys included.

    Keys with more than ``hot_rows`` rows are hot; ``hot`` names them where they are known already, else they are counted.  There
    are at most rows / ``hot_rows`` of them, and only they and the right rows they find are broadcast.  Every row goes one of two
    ways by its key alone, so a task that is computed again after an executor was lost gives the same rows.
    """
    keys = list(on)
    narrow = right.select(
        *[F.col(b).alias(f"__r{i}") for i, b in enumerate(on.values())], *[F.col(c).alias(f"__v_{c}") for c in columns]
    )
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)], F.lit(True))
    out = [*left.columns, *[F.col(f"__v_{c}").alias(c) for c in columns]]
    if hot is None:
        hot = left.groupBy(*keys).count().where(F.col("count") > hot_rows).select(*keys).collect()
    if not hot:
        return left.join(narrow, match, how).select(*out)
    marks = left.sparkSession.createDataFrame(hot, left.select(*keys).schema).toDF(*[f"__h_{k}" for k in keys])

    def is_hot(names: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__h_{k}")) for n, k in zip(names, keys, strict=True)])

    found = narrow.join(F.broadcast(marks), is_hot([f"__r{i}" for i in range(len(keys))]), "left_semi")
    rest = left.join(F.broadcast(marks), is_hot(keys), "left_anti").join(narrow, match, how)
    most = left.join(F.broadcast(marks), is_hot(keys), "left_semi").join(F.broadcast(found), match, how)
    return rest.select(*out).unionByName(most.select(*out))

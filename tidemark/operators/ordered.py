"""Ordered computations over groups of any size.

A window partitioned by a key puts a whole key into one task.  When the largest
group is small that is the best plan.  Beyond ``group_rows`` the rows are range
partitioned by key and order, each slice is computed on its own, and what the
earlier slices of the same key contribute is carried in.  Only a key that crosses
a slice boundary has anything to carry, so the carried table has fewer rows than
there are slices, which is what makes its broadcast safe.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import lookup, same_keys
from tidemark.session import settle, slices

#: Both ways give the same rows, types and order of NULLs; this only chooses the plan.
GROUP_ROWS = 4_000_000
SLICE_ROWS = 2_000_000

_SLICE = "__slice"
_CARRY = "__carry"


@dataclass(frozen=True)
class By:
    """One sort key with explicit null placement (nulls last by default)."""

    name: str
    desc: bool = False
    nulls_first: bool = False

    def column(self) -> Column:
        c = F.col(self.name)
        if self.desc:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


def as_order(order: Sequence[By | str]) -> list[By]:
    return [o if isinstance(o, By) else By(o) for o in order]


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the largest group; counted with map-side partial sums."""
    top = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(top["n"] or 0)


def slice_count(df: DataFrame) -> int:
    """As many slices as keep each at ``SLICE_ROWS`` rows, and no fewer than the session shuffles into."""
    return max(slices(df.sparkSession), -(-df.count() // SLICE_ROWS))


def fits_one_task(df: DataFrame, keys: Sequence[str], group_rows: int) -> bool:
    return bool(keys) and largest_group(df, keys) <= group_rows


def slice_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[By]) -> DataFrame:
    """Range partition by key and order, with the slice number as a column.

    Settled because range bounds come from sampling: two evaluations could cut the
    rows differently.
    """
    cut = df.repartitionByRange(
        slice_count(df), *[F.col(k).asc_nulls_first() for k in keys], *[o.column() for o in order]
    )
    return settle(cut.withColumn(_SLICE, F.spark_partition_id()))


def _carry_in(sliced: DataFrame, keys: Sequence[str], total: Column, fold) -> DataFrame:
    """Per (slice, key): the fold of ``total`` over the earlier slices of that key."""
    per = sliced.groupBy(_SLICE, *keys).agg(total.alias("__t"))
    if keys:
        earlier = Window.partitionBy(*keys)
    else:
        earlier = Window.partitionBy(F.lit(0))  # at most one row per slice
    earlier = earlier.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return (
        per.withColumn(_CARRY, fold("__t").over(earlier))
        .where(F.col(_CARRY).isNotNull())
        .select(_SLICE, *keys, _CARRY)
    )


def _with_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = (rows[_SLICE] == carry[_SLICE]) & same_keys(rows, carry, {k: k for k in keys})
    return rows.join(F.broadcast(carry), on, "left").select(*[rows[c] for c in rows.columns], carry[_CARRY])


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[By | str],
    value: str,
    name: str,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``sum(value)`` from the start of the group to the current row.

    ``order`` must be unique within a group, otherwise the result is arbitrary.
    """
    keys, order = list(keys), as_order(order)
    sort = [o.column() for o in order]
    frame = (Window.unboundedPreceding, Window.currentRow)
    if fits_one_task(df, keys, group_rows):
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*sort).rowsBetween(*frame)))
    sliced = slice_by_range(df, keys, order)
    local = Window.partitionBy(_SLICE, *keys).orderBy(*sort).rowsBetween(*frame)
    rows = sliced.withColumn(name, F.sum(value).over(local))
    carry = _carry_in(sliced, keys, F.sum(value), F.sum)
    out = _with_carry(rows, carry, keys)
    total = F.when(F.col(_CARRY).isNull(), F.col(name)).otherwise(F.coalesce(F.col(name), F.lit(0)) + F.col(_CARRY))
    # The type that one sum over the group has, not that of a sum of sums
    return out.withColumn(name, total.cast(df.select(F.sum(value).alias("s")).schema["s"].dataType)).drop(_SLICE, _CARRY)


def number_rows(df: DataFrame, order: Sequence[By | str], name: str) -> DataFrame:
    """All rows numbered from 1 in order, without a window: a row's place in its slice plus the sizes of the slices before.

    Slice and place are written with the rows, so they are data like any other; the sizes, one for each slice, come to the
    driver and go back as literals.
    """
    sort = [o.column() for o in as_order(order)]
    cut = df.repartitionByRange(slice_count(df), *sort).sortWithinPartitions(*sort)
    # The lower 33 bits count the rows of a partition
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sliced = settle(cut.select("*", F.spark_partition_id().alias(_SLICE), place.alias("__place")))
    sizes = {r[_SLICE]: r["count"] for r in sliced.groupBy(_SLICE).count().collect()}
    before = [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes, default=0)))]
    offset = F.get(F.expr(f"array({', '.join(f'{n}L' for n in before)})"), F.col(_SLICE))
    return sliced.select(*df.columns, (offset + F.col("__place") + 1).alias(name))


def row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[By | str], name: str, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Row number within a group, from 1; ``order`` must be unique within a group."""
    keys, order = list(keys), as_order(order)
    if not keys:
        return number_rows(df, order, name)
    if fits_one_task(df, keys, group_rows):
        w = Window.partitionBy(*keys).orderBy(*[o.column() for o in order])
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))
    ones = df.withColumn("__one", F.lit(1).cast("bigint"))
    return running_sum(ones, keys, order, "__one", name, group_rows=0).drop("__one")


def rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[By | str],
    name: str,
    dense: bool = False,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``rank`` or ``dense_rank``.  Large groups: peers are counted first, ranked, joined back."""
    keys, order = list(keys), as_order(order)
    sort = [o.column() for o in order]
    if fits_one_task(df, keys, group_rows):
        fn = F.dense_rank() if dense else F.rank()
        return df.withColumn(name, fn.over(Window.partitionBy(*keys).orderBy(*sort)).cast("bigint"))
    cols = keys + [o.name for o in order]
    peers = df.groupBy(*cols).agg(F.count("*").alias("__n"))
    step = F.lit(1).cast("bigint") if dense else F.col("__n")
    ranked = running_sum(peers.withColumn("__step", step), keys, order, "__step", "__upto", group_rows=0)
    ranked = ranked.select(*cols, (F.col("__upto") - F.col("__step") + 1).alias("__rank"))
    return lookup(df, ranked, {c: c for c in cols}, ["__rank"]).withColumnRenamed("__rank", name)


def shift(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[By | str],
    values: dict[str, str],
    n: int = 1,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Values of the row ``n`` places before (``n`` > 0) or after (``n`` < 0).

    ``values`` maps new column names to source columns.
    """
    keys, order = list(keys), as_order(order)
    if fits_one_task(df, keys, group_rows):
        w = Window.partitionBy(*keys).orderBy(*[o.column() for o in order])
        return df.withColumns({new: F.lag(src, n).over(w) for new, src in values.items()})
    numbered = row_number(df, keys, order, "__rn", group_rows=0)
    other = numbered.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        (F.col("__rn") + n).alias("__at"),
        *[F.col(src).alias(f"__v_{new}") for new, src in values.items()],
    )
    on = F.col("__rn") == F.col("__at")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = numbered.join(other, on, "left")
    return out.select(*df.columns, *[F.col(f"__v_{new}").alias(new) for new in values])


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Latest non-null ``value`` up to and including the current row, ascending order, NULLs first."""
    keys, order = list(keys), list(order)
    frame = (Window.unboundedPreceding, Window.currentRow)
    if fits_one_task(df, keys, group_rows):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    sliced = slice_by_range(df, keys, [By(o, nulls_first=True) for o in order])
    local = Window.partitionBy(_SLICE, *keys).orderBy(*order).rowsBetween(*frame)
    rows = sliced.withColumn(name, F.last(value, ignorenulls=True).over(local))
    newest = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    carry = _carry_in(sliced, keys, newest, lambda c: F.last(c, ignorenulls=True))
    out = _with_carry(rows, carry, keys)
    return out.withColumn(name, F.coalesce(name, _CARRY)).drop(_SLICE, _CARRY)


def dense_keys(df: DataFrame, natural: Sequence[str], name: str, start: int | Column = 0) -> DataFrame:
    """Consecutive numbers ``start + 1 ..`` in the order of a unique natural key."""
    numbered = row_number(df, [], list(natural), name, group_rows=0)
    return numbered.withColumn(name, F.col(name) + start)

"""Joins in the forms a warehouse load needs.

No broadcast is forced here: Catalyst broadcasts a side when its measured size is
under the configured limit and otherwise shuffles, and adaptive execution splits
skewed partitions of the sort-merge joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import GROUP_ROWS, last_known
from tidemark.operators.predicates import all_of, require_keys
from tidemark.operators.skew import lookup


MOST_CODES = 100_000


def _on(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    return all_of(left[a] == right[b] for a, b in pairs.items())


def inner(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> DataFrame:
    return left.join(right, _on(left, right, pairs))


def left_lookup(rows: DataFrame, history: DataFrame, on: dict[str, str], columns: Sequence[str]) -> DataFrame:
    """Left join to the distinct projection of a history: versions do not multiply rows."""
    found = history.where(all_of(F.col(c).isNotNull() for c in on.values())).select(*on.values(), *columns).distinct()
    return lookup(rows, found, on, columns)


def anti_not_in(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Composite NOT IN; a NULL key in the list is an error instead of an empty result."""
    return left.join(require_keys(right.select(*keys), keys), list(keys), "left_anti")


def semi_in(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_semi")


def in_either(left: DataFrame, first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key in one of two sets: one semi join against their union."""
    return semi_in(left, first.select(*keys).unionByName(second.select(*keys)), keys)


def exists(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left_semi")


def not_exists(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left_anti")


def null_safe(left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str = "inner") -> DataFrame:
    """Equal or both NULL."""
    return left.join(right, all_of(left[a].eqNullSafe(right[b]) for a, b in pairs.items()), how)


def full_outer_merge(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Union of two keyed value sets; the left value wins."""
    a = left.select(*keys, F.col(value).alias("__l"), F.lit(True).alias("__has"))
    b = right.select(*keys, F.col(value).alias("__r"))
    chosen = F.when(F.col("__has"), F.col("__l")).otherwise(F.col("__r")).alias(value)
    return a.join(b, list(keys), "full_outer").select(*keys, chosen)


def code_grid(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every combination of the code values that occur in the columns.

    NULL is a code like any other.  The values are gathered into arrays and exploded, so no
    join is made; meant for code columns, and refused for one with over ``MOST_CODES`` values.
    """
    few = F.struct(*[F.count_distinct(F.struct(c)).alias(c) for c in columns]).alias("n")
    counted = df.agg(few).first()["n"].asDict()
    many = [c for c, n in counted.items() if n > MOST_CODES]
    if many:
        raise ValueError(f"not code columns, more than {MOST_CODES} values: {many}")
    sets = df.agg(*[F.sort_array(F.collect_set(F.struct(c))).alias(c) for c in columns])
    for c in columns:
        sets = sets.withColumn(c, F.explode(c)).withColumn(c, F.col(c).getField(c))
    return sets


def or_join(left: DataFrame, right: DataFrame, first: dict[str, str], second: dict[str, str]) -> DataFrame:
    """Rows that meet one key equality or another, each pair once: two equi joins."""
    one = left.join(right, _on(left, right, first))
    not_first = ~F.coalesce(_on(left, right, first), F.lit(False))
    two = left.join(right, _on(left, right, second) & not_first)
    return one.unionByName(two)


def self_join_parent(df: DataFrame, key: str, parent: str, columns: dict[str, str], how: str = "left") -> DataFrame:
    """Each row with columns of its parent row; ``columns`` maps new names to parent columns."""
    up = df.select(F.col(key).alias("__pk"), *[F.col(src).alias(new) for new, src in columns.items()])
    return df.join(up, F.col(parent) == F.col("__pk"), how).drop("__pk")


def theta_array_join(
    rows: DataFrame, sets: DataFrame, parts: dict[str, Column], lead: str, how: str = "inner"
) -> DataFrame:
    """Rows whose derived parts are members of the array columns of a set row.

    ``parts`` maps array columns to values of the row.  The array ``lead`` is exploded
    and joined by equality; the others are tested on the joined rows.
    """
    opened = sets.withColumn("__lead", F.explode(F.array_distinct(lead)))
    valued = rows.withColumns({f"__p_{c}": v for c, v in parts.items()})
    cond = F.col(f"__p_{lead}") == F.col("__lead")
    for c in parts:
        if c != lead:
            cond = cond & F.array_contains(F.col(c), F.col(f"__p_{c}"))
    return valued.join(opened, cond, how).drop("__lead", *[f"__p_{c}" for c in parts])


def as_of_latest(
    rows: DataFrame,
    log: DataFrame,
    keys: Sequence[str],
    at: str,
    values: dict[str, str],
    tie: Sequence[str] = (),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Each row with the newest log entry of its key at or before its time.

    Both inputs have ``keys``, ``at`` and ``tie``; ``values`` maps new names to log
    columns.  Rows and log are merged into one ordered pass per key.  As in any
    comparison, a NULL key or time matches nothing.
    """
    known = all_of(F.col(c).isNotNull() for c in [*keys, at])
    log = log.where(known)
    entry = F.struct(*[F.col(src).alias(new) for new, src in values.items()]).alias("__entry")
    row = F.struct(*rows.columns)
    row_type = rows.select(row.alias("s")).schema["s"].dataType
    entry_type = log.select(entry).schema["__entry"].dataType
    a = rows.select(*keys, at, *tie, F.lit(1).alias("__side"), row.alias("__row"), F.lit(None).cast(entry_type).alias("__entry"))
    b = log.select(*keys, at, *tie, F.lit(0).alias("__side"), F.lit(None).cast(row_type).alias("__row"), entry)
    merged = last_known(a.unionByName(b), keys, [at, "__side", *tie], "__entry", "__found", group_rows)
    found = merged.where(F.col("__side") == 1)
    return found.select("__row.*", *[F.when(known, F.col(f"__found.{new}")).alias(new) for new in values])


def eav_pivot(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Attribute rows as columns, one aggregation instead of a join per attribute."""
    wanted = [F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names]
    return df.groupBy(*keys).agg(*wanted)


def at_group_max(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Rows holding the greatest value of their group (a correlated max)."""
    known = df.where(all_of(F.col(k).isNotNull() for k in keys))
    top = known.groupBy(*keys).agg(F.max(column).alias("__top"))
    return lookup(df, top, {k: k for k in keys}, ["__top"], "inner").where(F.col(column) == F.col("__top")).drop("__top")


def date_parts_join(rows: DataFrame, calendar: DataFrame, date: str, start: str, end: str) -> DataFrame:
    """Join on year, month and day, with the date inside the calendar row's bounds."""
    d = rows[date]
    on = (
        (F.year(d) == calendar["year"])
        & (F.month(d) == calendar["month"])
        & (F.dayofmonth(d) == calendar["day_of_month"])
        & (d >= calendar[start])
        & (d < calendar[end])
    )
    return rows.join(calendar, on)

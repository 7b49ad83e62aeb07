"""Filters and predicates built from column lists, validity windows and schemas."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN_END = "9999-12-31 23:59:59"


def ntz(text: str) -> Column:
    """Timestamp literal without time zone."""
    return F.lit(text).cast("timestamp_ntz")


def as_ts(value: str | Column) -> Column:
    return ntz(value) if isinstance(value, str) else value


def valid(ts: str | Column, start: str | Column = "start_ts", end: str | Column = "end_ts") -> Column:
    """Half-open validity: ``start <= ts < end``."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return (as_ts(ts) >= start) & (as_ts(ts) < end)


def valid_at(df: DataFrame, ts: str | Column, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    return df.where(valid(ts, start, end))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def comparable(df: DataFrame, ids: Sequence[str], hist: Sequence[str]) -> list[str]:
    """Columns that take part in change detection: all but keys and history columns."""
    left_out = {*ids, *hist}
    return [c for c in df.columns if c not in left_out]


def changed(old: str, new: str, columns: Sequence[str]) -> Column:
    """True when any column differs between two aliased sides, NULL being a value.

    With no column to compare nothing ever differs.
    """
    return any_of(~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}")) for c in columns)


def keys_match(old: str, new: str, ids: Sequence[str]) -> Column:
    return all_of(F.col(f"{old}.{c}") == F.col(f"{new}.{c}") for c in ids)


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Pass rows through and fail the job on the first row that breaks ``condition``."""
    ok = F.coalesce(condition, F.lit(False))
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def require_keys(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return require(df, all_of(F.col(c).isNotNull() for c in ids), f"NULL in key columns {list(ids)}")


def non_empty(column: str) -> Column:
    """Lists that are neither NULL nor empty."""
    return F.coalesce(F.size(column) > 0, F.lit(False))


def similar_to(column: str | Column, pattern: str) -> Column:
    """Whole-string match of a regular expression."""
    c = F.col(column) if isinstance(column, str) else column
    return c.rlike(rf"\A(?:{pattern})\z")


def contained_in(inner: str | Column, outer: str | Column) -> Column:
    """Every element of one array is in another."""
    return F.size(F.array_except(inner, outer)) == 0


def directional(column: str | Column, start: Column, direction: int) -> Column:
    """At or after ``start`` when going forward, at or before it when going backward."""
    c = F.col(column) if isinstance(column, str) else column
    return c >= start if direction > 0 else c <= start

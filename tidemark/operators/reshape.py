"""Splitting lists into rows, chunking control lists, series, templates and derived predicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.predicates import changed, comparable, keys_match, non_empty


def text_to_list(column: str | Column, sep: str) -> Column:
    """Delimited text as an array; the empty text is the empty array."""
    c = F.col(column) if isinstance(column, str) else column
    quoted = "".join(f"\\{ch}" if not ch.isalnum() and not ch.isspace() else ch for ch in sep)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, quoted))


def split_ordered(df: DataFrame, keys: Sequence[str], column: str, sep: str, element: str) -> DataFrame:
    """(keys, order_num from 1, element), one row per list element; row-local, no shuffle."""
    listed = df.select(*keys, text_to_list(column, sep).alias("__list")).where(non_empty("__list"))
    exploded = listed.select(*keys, F.posexplode("__list").alias("__pos", element))
    return exploded.select(*keys, (F.col("__pos") + 1).alias("order_num"), element)


def chunk_list(items: Sequence[str], names: Sequence[str]) -> list[dict[str, str]]:
    """A control list consumed ``len(names)`` members at a time."""
    k = len(names)
    if len(items) % k:
        raise ValueError(f"list of {len(items)} members cannot be cut into groups of {k}")
    return [dict(zip(names, items[i : i + k], strict=True)) for i in range(0, len(items), k)]


def fan_out_list(df: DataFrame, keys: Sequence[str], column: str, names: Sequence[str]) -> DataFrame:
    """Rows of named members from a flat array column, ``len(names)`` members per row."""
    k = len(names)
    starts = F.when(F.size(column) >= 1, F.sequence(F.lit(1), F.size(column), F.lit(k)))
    rows = df.select(*keys, column, F.posexplode(starts).alias("__i", "__at"))
    member = [F.get(column, F.col("__at") - 1 + i).alias(n) for i, n in enumerate(names)]
    return rows.select(*keys, (F.col("__i") + 1).alias("iteration"), *member)


def number_series(df: DataFrame, keys: Sequence[str], upto: str | Column, name: str) -> DataFrame:
    """0 .. upto for every row."""
    n = F.col(upto) if isinstance(upto, str) else upto
    return df.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint"))).alias(name))


def date_series(df: DataFrame, keys: Sequence[str], start: str | Column, days: int, direction: int, name: str) -> DataFrame:
    """``days`` dates from ``start`` on, forward or backward, the start included."""
    s = (F.col(start) if isinstance(start, str) else start).cast("date")
    seq = F.sequence(s, F.date_add(s, direction * (days - 1)))
    return df.select(*keys, F.posexplode(seq).alias("seq", name))


def minute_floor(ts: str | Column) -> Column:
    """Start of the minute; built from parts because truncation would go through the session's time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(c).cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(c), mins=F.minute(c))


def minute_series(df: DataFrame, keys: Sequence[str], start: str, minutes: int, name: str) -> DataFrame:
    """Every minute from the minute of ``start`` on."""
    s = minute_floor(start)
    stop = s + F.make_dt_interval(mins=F.lit(minutes))
    return df.select(*keys, F.posexplode(F.sequence(s, stop, F.expr("interval 1 minute"))).alias("seq", name))


def nth_minute(df: DataFrame, start: str, minutes: int, n: int, match: Callable[[Column], Column], name: str) -> DataFrame:
    """The n-th matching minute from the minute of ``start`` on, looked for inside the row."""
    s = minute_floor(start)
    seq = F.sequence(s, s + F.make_dt_interval(mins=F.lit(minutes)), F.expr("interval 1 minute"))
    return df.withColumn(name, F.get(F.filter(seq, match), F.lit(n - 1)))


def render(template: str | Column, features: str | Column) -> Column:
    """Replace ``${name}`` by the value of a map; unknown names become empty.

    The text is cut at ``${`` and each piece at its first ``}``: values are never
    scanned again, so a value that looks like a placeholder stays as it is.
    """
    t = F.lit(template) if isinstance(template, str) else template
    m = F.col(features) if isinstance(features, str) else features
    pieces = F.split(t, r"\$\{")

    def piece(p: Column) -> Column:
        name = F.substring_index(p, "}", 1)
        value = F.coalesce(F.try_element_at(m, name), F.lit(""))
        closed = F.locate("}", p) > 0
        tail = F.when(closed, p.substr(F.length(name) + 2, F.length(p))).otherwise(F.lit(""))
        return F.concat(value, tail)

    rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), piece)
    return F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))


def render_template(df: DataFrame, template: str | Column, features: str, name: str) -> DataFrame:
    return df.withColumn(name, render(template, features))


def predicate_from_schema(
    target: DataFrame, ids: Sequence[str], hist: Sequence[str], old: str, new: str
) -> tuple[Column, Column]:
    """Key equality and null-aware change condition derived from a table's columns."""
    return keys_match(old, new, ids), changed(old, new, comparable(target, ids, hist))


def path_parent(df: DataFrame, path: str) -> DataFrame:
    """Parent path and position of a materialised path."""
    return df.withColumns(
        {
            "parent_path": F.when(F.size(path) > 0, F.slice(path, 1, F.size(path) - 1)),
            "position": F.when(F.size(path) > 0, F.element_at(path, -1)),
        }
    )

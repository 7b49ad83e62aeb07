"""Scalar functions that Spark has no single built-in for; all of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def list_element(text: str | Column, n: int, sep: str = ",") -> Column:
    """The n-th element of a delimited list, from 1; NULL beyond the end."""
    return F.get(F.split(F.trim(_c(text)), re.escape(sep)), F.lit(n - 1))


def list_length(text: str | Column, sep: str = ",") -> Column:
    return F.size(F.split(F.trim(_c(text)), re.escape(sep)))


def nth_position(text: str | Column, part: str, n: int) -> Column:
    """Position of the n-th occurrence of ``part``, 0 if there are fewer."""
    t = _c(text)
    enough = F.size(F.split(t, re.escape(part))) > n
    return F.when(enough, F.length(F.substring_index(t, part, n)) + 1).otherwise(0)


def month_reverse_day(date: str | Column) -> Column:
    """Days to the first of the next month: 1 on the last day."""
    d = _c(date)
    return F.datediff(F.add_months(F.trunc(d, "MM"), 1), d)


def load_number(ts: str | Column) -> Column:
    """Timestamp as the number yyyyMMddHHmmss, without a detour through the session's time zone."""
    shown = F.substring(_c(ts).cast("timestamp_ntz").cast("string"), 1, 19)
    return F.regexp_replace(shown, "[^0-9]", "").cast("bigint")


def load_time(number: str | Column) -> Column:
    return F.to_timestamp_ntz(_c(number).cast("string"), F.lit("yyyyMMddHHmmss"))


def pack_date(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    """Date parts as one sortable number."""
    return (((year.cast("bigint") * 100 + month) * 100 + day) * 100 + hour) * 100 + minute


def shift_minutes(ts: str | Column, minutes: str | Column) -> Column:
    return _c(ts) + F.make_dt_interval(mins=_c(minutes))


def unescape(text: str | Column) -> Column:
    """Drop each backslash and keep the character after it."""
    return F.regexp_replace(_c(text), r"(?s)\\(.?)", "$1")


def quote(text: str | Column) -> Column:
    """Enclose in double quotes, escaping those inside."""
    return F.concat(F.lit('"'), F.replace(_c(text), F.lit('"'), F.lit('\\"')), F.lit('"'))


def head(items: str | Column) -> Column:
    """First element; an inner list stays whole."""
    return F.get(_c(items), F.lit(0))


def tail(items: str | Column) -> Column:
    """All but the first element."""
    c = _c(items)
    return F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))


def zip_to_map(names: str | Column, values: str | Column) -> Column:
    return F.map_from_arrays(_c(names), _c(values))


def map_merge(over: str | Column, base: str | Column) -> Column:
    """Union of two maps; the first wins."""
    over, base = _c(over), _c(base)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def join_list(lists: str | Column, sep: str = "") -> Column:
    """Nested lists as one text, structure lost."""
    return F.array_join(F.flatten(_c(lists)), sep)

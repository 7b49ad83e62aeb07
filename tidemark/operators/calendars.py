"""Cron-like calendars as tables.

A schedule is one row: an id and ``alts``, an array of alternatives, each with the
sets of minutes, hours, days, reverse days (1 = last day of the month), months and
ISO weekdays it allows.  Dates and slots are generated inside the row with array
functions, so no product of the sets is ever built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import shift

# Fields of a schedule in their written order, with the range a star stands for.
FIELDS = [
    ("minutes", 0, 59),
    ("hours", 0, 23),
    ("days", 1, 31),
    ("rdays", 1, 31),
    ("months", 1, 12),
    ("wdays", 1, 7),
]
HORIZON = 1466  # dates of a candidate list: four years and some days
CYCLE = 146_097  # days after which the calendar repeats, weekdays included: 400 years
WORD, WORDS = 60, 80  # months in a word of the index, and words for the 4800 months of the cycle


def _field_set(text: Column, low: int, high: int) -> Column:
    """``1-3,9`` or ``*`` as a sorted set of numbers; a backward range is empty, and any other text fails the job."""

    def item(part: Column) -> Column:
        ends = F.split(part, "-")
        first, last = F.get(ends, F.lit(0)).try_cast("int"), F.get(ends, F.size(ends) - 1).try_cast("int")
        numbers = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        fits = first.between(low, high) & last.between(low, high) & (F.size(ends) <= 2)
        wrong = F.raise_error(F.concat(F.lit(f"not in {low}-{high}: "), part)).cast("array<int>")
        checked = F.when(F.coalesce(fits, F.lit(False)), numbers).otherwise(wrong)
        return F.when(part == "*", F.sequence(F.lit(low), F.lit(high))).otherwise(checked)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(text, ","), item))))


def expand_cron(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per alternative with a set per field.

    Fields are separated by ``&`` or blanks and alternatives by ``|``.  A five-field
    alternative is classic cron, which has no reverse day: any will do. Any other number of
    fields fails the job.
    """
    one = df.select(*keys, F.posexplode(F.split(text, r"\|")).alias("position", "__alt"))
    tidy = F.regexp_replace(F.regexp_replace(F.trim("__alt"), r"\s*([,-])\s*", "$1"), r"\s*&\s*|\s+", " ")
    parts = F.split(tidy, " ")
    parts = F.when(F.size(parts) == 5, F.flatten(F.array(F.slice(parts, 1, 3), F.array(F.lit("*")), F.slice(parts, 4, 2))))\
        .when(F.size(parts) == 6, parts).otherwise(F.raise_error(F.concat(F.lit("fields not in 5 or 6: "), F.col("__alt"))).cast("array<string>"))
    split = one.select(*keys, "position", parts.alias("__parts"))
    sets = [_field_set(F.get("__parts", F.lit(i)), lo, hi).alias(name) for i, (name, lo, hi) in enumerate(FIELDS)]
    return split.select(*keys, "position", *sets)


def as_alternatives(expanded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per schedule; the alternatives are the few its author wrote down."""
    entry = F.struct("position", *[name for name, _, _ in FIELDS])
    return expanded.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("alts"))


def normalise_schedules(schedules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Array of alternatives back to one row each."""
    return schedules.select(*keys, F.inline("alts"))


def reverse_day(d: Column) -> Column:
    """Days to the first of the next month: the last day is 1."""
    return F.datediff(F.add_months(F.trunc(d, "MM"), 1), d)


def iso_weekday(d: Column) -> Column:
    return F.weekday(d) + 1


def date_parts(d: Column) -> list[Column]:
    return [
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day_of_month"),
        reverse_day(d).alias("day_of_month_reverse"),
        iso_weekday(d).alias("day_of_week"),
    ]


def calendar_dim(bounds: DataFrame, start: str, end: str, keys: Sequence[str] = ()) -> DataFrame:
    """Every date between two columns, both included, with its parts."""
    dates = bounds.select(*keys, F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("date"))
    return dates.select(*keys, "date", *date_parts(F.col("date")))


def candidate_dates(df: DataFrame, keys: Sequence[str], start: str, direction: int, horizon: int = HORIZON) -> DataFrame:
    """The next or previous ``horizon`` dates of every row, the start included as number 0."""
    d = F.to_date(start)
    seq = F.sequence(d, F.date_add(d, direction * (horizon - 1)))
    dates = df.select(*keys, F.posexplode(seq).alias("seq", "date"))
    return dates.select(*keys, "seq", "date", *date_parts(F.col("date")))


def _fits(alt: Column, d: Column) -> Column:
    return (
        F.array_contains(alt["days"], F.dayofmonth(d))
        & F.array_contains(alt["rdays"], reverse_day(d))
        & F.array_contains(alt["months"], F.month(d))
        & F.array_contains(alt["wdays"], iso_weekday(d))
        & (F.size(alt["hours"]) > 0)
        & (F.size(alt["minutes"]) > 0)
    )


def _on_schedule(alts: Column, d: Column) -> Column:
    return F.exists(alts, lambda a: _fits(a, d))


def _minutes_of_day(alts: Column, d: Column) -> Column:
    """Sorted minutes of the day at which any alternative fires on ``d``."""

    def times(alt: Column) -> Column:
        return F.flatten(F.transform(alt["hours"], lambda h: F.transform(alt["minutes"], lambda m: h * 60 + m)))

    chosen = F.filter(alts, lambda a: _fits(a, d))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(chosen, times))))


def _at(d: Column, minute: Column) -> Column:
    return d.cast("timestamp_ntz") + F.make_dt_interval(mins=minute)


def schedule_dates(schedules: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Scheduled dates between two columns; each date once however many alternatives allow it."""
    dates = F.filter(F.sequence(F.to_date(start), F.to_date(end)), lambda d: _on_schedule(F.col("alts"), d))
    return schedules.select(*keys, F.explode(dates).alias("date"))


def schedule_slots(schedules: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Every scheduled timestamp on the dates between two columns."""
    dates = schedules.select(*keys, "alts", F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("date"))
    slots = dates.select(*keys, "date", F.explode(_minutes_of_day(F.col("alts"), F.col("date"))).alias("minute"))
    return slots.select(*keys, _at(F.col("date"), F.col("minute")).alias("slot_ts"))


def _kind(first: str) -> str:
    """Number 0 to 90 of the kind of a month, from its first day: January, two Februaries, March and so on, each by weekday."""
    return f"((month({first}) - 1 + if(month({first}) > 2 or day(last_day({first})) = 29, 1, 0)) * 7 + weekday({first}))"


#: The 91 kinds of months: number, length, and weekday of the first, Monday 0; in the order of ``_kind``.
_KINDS = """
    transform(sequence(0, 12), q -> named_struct('month', if(q < 2, q + 1, q), 'length', case when q = 1 then 28 when q = 2 then 29 when q in (4, 6, 9, 11) then 30 else 31 end))"""
#: The scheduled days of each kind of month, the first of the month as lowest bit.
_DAYS = f"""
    transform(flatten(transform({_KINDS}, m -> transform(sequence(0, 6), w -> named_struct('month', m.month, 'length', m.length, 'first', w)))),
      m -> aggregate(alts, 0L, (x, a) -> x | if(array_contains(a.months, m.month) and size(a.hours) > 0 and size(a.minutes) > 0,
        aggregate(filter(a.days, n -> n <= m.length), 0L, (b, n) -> b | shiftleft(1L, n - 1))
        & aggregate(filter(a.rdays, n -> n <= m.length), 0L, (b, n) -> b | shiftleft(1L, m.length - n))
        & aggregate(filter(sequence(0, 30), i -> array_contains(a.wdays, (m.first + i) % 7 + 1)), 0L, (b, i) -> b | shiftleft(1L, i)), 0L)))"""


def with_index(schedules: DataFrame) -> DataFrame:
    """``schedules`` with a column ``index`` made from ``alts``.

    ``days``: scheduled days by kind of month; ``months``: those of the cycle from January 2000 on that have any, in words;
    ``after`` and ``before``: how many words on and back from each, around the cycle, the nearest one is that is not zero.
    """
    out = schedules.withColumn("__days", F.expr(_DAYS))
    month = "add_months(date'2000-01-01', {c})"
    word = f"aggregate(sequence(0, {WORD - 1}), 0L, (x, i) -> x | if(__days[{_kind(month.format(c=f'w * {WORD} + i'))}] <> 0, shiftleft(1L, i), 0L))"
    out = out.withColumn("__months", F.expr(f"transform(sequence(0, {WORDS - 1}), w -> {word})"))
    near = "transform(sequence(0, {n}), w -> try_element_at(filter(sequence(1, {m}), s -> __months[pmod(w {sign} s, {m})] <> 0), 1))"
    after, before = (F.expr(near.format(n=WORDS - 1, m=WORDS, sign=sign)) for sign in "+-")
    index = F.struct(F.col("__days").alias("days"), F.col("__months").alias("months"), after.alias("after"), before.alias("before"))
    return out.withColumn("index", index).drop("__days", "__months")


def _nearest_date(df: DataFrame, date: str, name: str, direction: int) -> DataFrame:
    """The nearest scheduled date after (+1) or before (-1) ``date``, by the row's ``index``; NULL if there is none."""
    low = lambda x: f"bit_count(({x} & -{x}) - 1)"
    high = lambda x: f"(length(bin({x})) - 1)"
    end, near, sign = (low, "after", "+") if direction > 0 else (high, "before", "-")
    beyond = (lambda x, n: f"({x} & ~(shiftleft({n[0]}, {n[1]}) - 1))") if direction > 0 else (lambda x, n: f"({x} & (shiftleft({n[0]}, {n[1]}) - 1))")
    skip = 0 if direction > 0 else 1  # places up to the one itself, or before it
    steps = {
        "__first": f"trunc({date}, 'MM')",
        "__rest": beyond(f"index.days[{_kind('__first')}]", ("1L", f"day({date}) - {skip}")),
        "__c": "pmod((year(__first) - 2000) * 12 + month(__first) - 1, 4800)",
        "__w": f"cast(__c div {WORD} as int)",
        "__here": beyond("index.months[__w]", ("1L", f"cast(__c % {WORD} as int) + {1 - skip}")),
        "__step": f"if(__here <> 0, 0, index.{near}[__w])",
        "__bits": f"if(__here <> 0, __here, index.months[pmod(__w {sign} __step, {WORDS})])",
        "__month": f"add_months(__first, cast((__w {sign} __step) * {WORD} + {end('__bits')} - __c as int))",
        "__there": f"if(__rest <> 0, __rest, index.days[{_kind('__month')}])",
        name: f"if(__rest <> 0, date_add(__first, cast({end('__rest')} as int)), date_add(__month, cast({end('__there')} as int)))",
    }
    df = df.selectExpr("*", *[f"{expression} as {column}" for column, expression in steps.items()])
    return df.drop(*[c for c in steps if c != name])


def nearest_run(
    df: DataFrame,
    ts: str,
    name: str,
    direction: int,
    same_allowed: bool = False,
    horizon: int = CYCLE,
) -> DataFrame:
    """Nearest scheduled timestamp after (+1) or before (-1) each row's ``ts``.

    Rows carry their schedule in ``alts``, and its index from ``with_index``, best made before rows
    are joined to schedules; where it is missing it is made here, once per different schedule.  Slots are only
    generated for the date of ``ts`` and, if none there is on the right side, for the nearest other date.  A date
    ``horizon`` or more days away counts as none; by default that is a whole cycle, so NULL means never.
    """
    had = "index" in df.columns
    if not had:
        plans = with_index(df.select("alts").distinct()).withColumnRenamed("alts", "__alts")
        df = df.join(plans, F.col("alts").eqNullSafe(F.col("__alts"))).drop("__alts")
    at = F.col(ts).cast("timestamp_ntz")
    df = _nearest_date(df.withColumn("__d", F.to_date(ts)), "__d", "__near", direction)

    def slots(d: str) -> Column:
        return F.transform(_minutes_of_day(F.col("alts"), F.col(d)), lambda m: _at(F.col(d), m))

    if direction > 0:
        right = F.filter(slots("__d"), lambda s: (s >= at) if same_allowed else (s > at))
        best = F.array_min
    else:
        right = F.filter(slots("__d"), lambda s: (s <= at) if same_allowed else (s < at))
        best = F.array_max
    near_enough = F.abs(F.datediff("__near", "__d")) < horizon
    df = df.withColumn("__today", best(right))
    found = F.when(F.col("__today").isNotNull(), F.col("__today")).when(near_enough, best(slots("__near")))
    return df.withColumn(name, found).drop("__d", "__near", "__today", *([] if had else ["index"]))


def next_run(df: DataFrame, ts: str, name: str = "next_run", same_allowed: bool = False, horizon: int = CYCLE) -> DataFrame:
    return nearest_run(df, ts, name, +1, same_allowed, horizon)


def prev_run(df: DataFrame, ts: str, name: str = "prev_run", same_allowed: bool = False, horizon: int = CYCLE) -> DataFrame:
    return nearest_run(df, ts, name, -1, same_allowed, horizon)


def slot_days(schedules: DataFrame, key: str, start: str, end: str, horizon: int = CYCLE) -> DataFrame:
    """Per schedule and date: the day's slots, and the nearest slots of other days.

    The window runs over the dates of one schedule, whose number is set by the
    calendar and not by the facts.  What lies before the first and after the last
    date is looked up once per schedule.
    """
    first, last = F.to_date(start), F.to_date(end)
    edges = schedules.select(
        key, "alts", first.alias("__a"), last.alias("__b"),
        first.cast("timestamp_ntz").alias("__from"), F.date_add(last, 1).cast("timestamp_ntz").alias("__to"),
    )
    edges = with_index(edges)
    edges = nearest_run(edges, "__from", "__before", -1, horizon=horizon)
    edges = nearest_run(edges, "__to", "__after", +1, same_allowed=True, horizon=horizon)
    days = edges.select(key, "alts", "__before", "__after", F.explode(F.sequence("__a", "__b")).alias("date"))
    minutes = _minutes_of_day(F.col("alts"), F.col("date"))
    slots = F.transform(minutes, lambda m: _at(F.col("date"), m)).alias("slots")
    days = days.select(key, "date", "__before", "__after", slots)
    some = F.size("slots") > 0
    order = Window.partitionBy(key).orderBy("date")
    before = F.last(F.when(some, F.element_at("slots", -1)), ignorenulls=True)
    after = F.first(F.when(some, F.element_at("slots", 1)), ignorenulls=True)
    return days.select(
        key, "date", "slots",
        F.coalesce(before.over(order.rowsBetween(Window.unboundedPreceding, -1)), "__before").alias("prev_day_slot"),
        F.coalesce(after.over(order.rowsBetween(1, Window.unboundedFollowing)), "__after").alias("next_day_slot"),
    )


def align_to_schedule(facts: DataFrame, schedules: DataFrame, key: str, ts: str, horizon: int = CYCLE) -> DataFrame:
    """Previous (at or before) and next (after) slot for every row of a fact table.

    One equi join on (schedule, date).  ``schedules`` has ``key``, ``alts`` and the
    range ``first_ts`` .. ``last_ts`` the facts of that schedule lie in.
    """
    dim = slot_days(schedules, key, "first_ts", "last_ts", horizon).withColumnRenamed(key, "__key")
    at = F.col(ts)
    joined = facts.join(dim, (F.col(key) == F.col("__key")) & (F.to_date(ts) == F.col("date")), "left")
    done = F.filter("slots", lambda s: s <= at)
    due = F.filter("slots", lambda s: s > at)
    return joined.select(
        *facts.columns,
        F.coalesce(F.array_max(done), "prev_day_slot").alias("prev_slot"),
        F.coalesce(F.array_min(due), "next_day_slot").alias("next_slot"),
    )


def last_day_rules(df: DataFrame, date: str) -> DataFrame:
    """The three ways of saying "last day of the month"."""
    d = F.to_date(date)
    return df.withColumns(
        {
            "by_reverse_day": reverse_day(d) == 1,
            "by_day_zero": F.month(d) != F.month(F.date_add(d, 1)),
            "by_day_32": d == F.last_day(d),
        }
    )


def shift_slots(slots: DataFrame, keys: Sequence[str], ts: str, n: int, name: str) -> DataFrame:
    """The slot ``n`` places after (``n`` > 0) or before (``n`` < 0) each slot; 0 is the slot itself."""
    if n == 0:
        return slots.withColumn(name, F.col(ts))
    return shift(slots, keys, [ts], {name: ts}, -n)

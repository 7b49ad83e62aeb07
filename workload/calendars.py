"""Schedules gathered from the event log, and facts aligned to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import calendars as C
from workload.base import day, query, stamp, table, text

# Schedule texts of two alternatives, written from customer attributes.
CRON_SQL = """
  select c_custkey,
    c_nationkey || ', ' || (c_nationkey + 30) || ' & ' || (c_custkey % 12) || ' - ' || (c_custkey % 12 + c_nationkey % 12)
    || ' & 2,16 & * & 2-4,8-11 & ' || (c_custkey % 7 + 1)
    || ' | 0 & * & * & 1,' || (c_nationkey % 5 + 2) || ' & ' || (c_nationkey % 12 + 1) || '-6 & *' as spec
  from customer"""


def cron_texts(spark, sf):
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    lit = F.lit
    first = F.concat(n, lit(", "), n + 30, lit(" & "), k % 12, lit(" - "), k % 12 + n % 12,
                     lit(" & 2,16 & * & 2-4,8-11 & "), k % 7 + 1)
    second = F.concat(lit("0 & * & * & 1,"), n % 5 + 2, lit(" & "), n % 12 + 1, lit("-6 & *"))
    return table(spark, sf, "customer").select("c_custkey", F.concat(first, lit(" | "), second).alias("spec"))


def set_sql(field: int, low: int, high: int) -> str:
    return f"""array_to_string(list_sort(list_distinct(flatten(list_transform(string_split(f[{field}], ','),
        lambda x: case when x = '*' then range({low}, {high + 1})
                       else range(cast(string_split(x, '-')[1] as bigint), cast(string_split(x, '-')[-1] as bigint) + 1)
                  end)))), ',')"""


@query(
    "expand_cron",
    f"""with t as ({CRON_SQL}),
    a as (select c_custkey, unnest(string_split(spec, '|')) as alt,
                 (generate_subscripts(string_split(spec, '|'), 1) - 1)::int as position from t),
    s as (select c_custkey, position, string_split(replace(alt, ' ', ''), '&') as f from a)
    select c_custkey, position, """
    + ", ".join(f"{set_sql(i, lo, hi)} as {name}" for i, (name, lo, hi) in enumerate(C.FIELDS, start=1))
    + " from s",
)
def expand_cron(spark, sf):
    sets = C.expand_cron(cron_texts(spark, sf), ["c_custkey"], "spec")
    shown = [F.array_join(F.col(name).cast("array<string>"), ",").alias(name) for name, _, _ in C.FIELDS]
    return sets.select("c_custkey", "position", *shown)


# One schedule per event type.  Large and small values make two alternatives, each field a
# coarse grid over the times at which such events occurred.
SCHEDULE_CTE = """
  e as (select event_type, case when value >= 35 then 0 else 1 end as position, cast(ts as date) as d,
               hour(ts) as h, minute(ts) as m, length(event_type) as n, ts from events),
  sch as (
    select event_type, position,
      list_sort(list(distinct case position when 0 then m // 20 * 20 + n else m // 30 * 30 end)) as minutes,
      list_sort(list(distinct case position when 0 then h // 8 * 8 + n - 4 else h // 12 * 12 end)) as hours,
      list_sort(list(distinct case position when 0 then (day(d) - 1) // 10 * 10 + 1 else day(d) end)) as days,
      list_sort(list(distinct case position when 0 then day(d)
                              else date_diff('day', d, date_trunc('month', d + interval 1 month)) // 8 + 1 end)) as rdays,
      list_sort(list(distinct case position when 0 then isodow(d) else isodow(d) // 4 * 4 + 1 end)) as wdays
    from e group by event_type, position),
  cal as (select cast(x as date) as d from generate_series(timestamp '2023-11-01', timestamp '2024-03-31', interval 1 day) t(x)),
  fit as (select event_type, position, hours, minutes, d from sch, cal
          where list_contains(days, day(d)) and list_contains(wdays, isodow(d))
            and list_contains(rdays, date_diff('day', d, date_trunc('month', d + interval 1 month)))),
  slots as (select distinct event_type, cast(d as timestamp) + to_minutes(cast(h * 60 + m as bigint)) as slot_ts
            from (select event_type, d, m, unnest(hours) as h from (select event_type, d, hours, unnest(minutes) as m from fit)))
"""


def schedule_rows(spark, sf):
    """(event_type, position, a set per field), in any month."""
    ts = F.col("ts")
    d, n = F.to_date(ts), F.length("event_type")
    first = F.col("position") == 0
    pick = lambda a, b: F.array_sort(F.collect_set(F.when(first, a).otherwise(b).cast("int")))
    grid = lambda c, step: F.floor(c / step) * step
    dom, rday, wday = F.dayofmonth(d), C.reverse_day(d), C.iso_weekday(d)
    sets = {
        "minutes": pick(grid(F.minute(ts), 20) + n, grid(F.minute(ts), 30)),
        "hours": pick(grid(F.hour(ts), 8) + n - 4, grid(F.hour(ts), 12)),
        "days": pick(grid(dom - 1, 10) + 1, dom),
        "rdays": pick(dom, F.floor(rday / 8) + 1),
        "months": F.first(F.sequence(F.lit(1), F.lit(12))),
        "wdays": pick(wday, grid(wday, 4) + 1),
    }
    events = table(spark, sf, "events").withColumn("position", F.when(F.col("value") >= 35, 0).otherwise(1))
    return events.groupBy("event_type", "position").agg(*[c.alias(name) for name, c in sets.items()])


def event_schedules(spark, sf):
    """One row per event type: alternatives and the range of its events."""
    span = table(spark, sf, "events").groupBy("event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return C.as_alternatives(schedule_rows(spark, sf), ["event_type"]).join(span, "event_type")


@query(
    "calendar_dim",
    """with b as (select min(l_shipdate) as a, max(l_shipdate) as z from lineitem),
    cal as (select cast(unnest(generate_series(a, z, interval 1 day)) as date) as d from b),
    n as (select cast(l_shipdate as date) as s, count(*) as n from lineitem group by 1)
    select strftime(d, '%Y-%m-%d') as date, year(d)::int as year, month(d)::int as month, day(d)::int as day_of_month,
           date_diff('day', d, date_trunc('month', d + interval 1 month))::int as day_of_month_reverse,
           isodow(d)::int as day_of_week, coalesce(n, 0) as n_lines
    from cal left join n on s = d""",
)
def calendar_dim(spark, sf):
    lines = table(spark, sf, "lineitem")
    daily = lines.groupBy(F.to_date("l_shipdate").alias("s")).agg(F.count("*").alias("n"))
    bounds = daily.agg(F.min("s").alias("a"), F.max("s").alias("z"))
    joined = C.calendar_dim(bounds, "a", "z").join(daily, F.col("date") == F.col("s"), "left")
    return joined.select(day("date").alias("date"), "year", "month", "day_of_month", "day_of_month_reverse", "day_of_week",
                         F.coalesce("n", F.lit(0)).cast("bigint").alias("n_lines"))


@query(
    "candidate_dates",
    """with l as (select o_custkey, max(o_orderdate) as a from orders group by o_custkey),
    x as (select o_custkey, s as seq, cast(a - to_days(cast(s as integer)) as date) as d from l, range(0, 40) r(s))
    select o_custkey, seq::int as seq, strftime(d, '%Y-%m-%d') as date, isodow(d)::int as day_of_week,
           date_diff('day', d, date_trunc('month', d + interval 1 month))::int as day_of_month_reverse from x""",
)
def candidate_dates(spark, sf):
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("a"))
    dates = C.candidate_dates(last, ["o_custkey"], "a", -1, horizon=40)
    return dates.select("o_custkey", "seq", day("date").alias("date"), "day_of_week", "day_of_month_reverse")


@query(
    "schedule_dates",
    f"""with {SCHEDULE_CTE}, r as (select event_type, min(d) as a, max(d) as z from e group by 1)
    select distinct fit.event_type, strftime(d, '%Y-%m-%d') as date from fit join r using (event_type) where d between a and z""",
)
def schedule_dates(spark, sf):
    return C.schedule_dates(event_schedules(spark, sf), ["event_type"], "first_ts", "last_ts").withColumn("date", day("date"))


@query(
    "schedule_slots",
    f"""with {SCHEDULE_CTE}, r as (select event_type, min(d) as a, max(d) as z from e group by 1)
    select event_type, {stamp('slot_ts')} as slot_ts from slots join r using (event_type)
    where cast(slot_ts as date) between a and z""",
)
def schedule_slots(spark, sf):
    return C.schedule_slots(event_schedules(spark, sf), ["event_type"], "first_ts", "last_ts").withColumn("slot_ts", text("slot_ts"))


LAST_EVENT = """last as (select user_id, event_type, ts from events
                 qualify row_number() over (partition by user_id order by ts desc) = 1)"""


def lookups(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max_by(F.struct("event_type", "ts"), "ts").alias("e"))
    return last.select("user_id", "e.event_type", "e.ts").join(C.with_index(event_schedules(spark, sf)), "event_type")


@query(
    "next_run",
    f"""with {SCHEDULE_CTE}, {LAST_EVENT}
    select user_id, (select {stamp('min(slot_ts)')} from slots s where s.event_type = l.event_type and s.slot_ts > l.ts) as next_run
    from last l""",
)
def next_run(spark, sf):
    return C.next_run(lookups(spark, sf), "ts").select("user_id", text("next_run").alias("next_run"))


@query(
    "prev_run",
    f"""with {SCHEDULE_CTE}, {LAST_EVENT}
    select user_id, (select {stamp('max(slot_ts)')} from slots s where s.event_type = l.event_type and s.slot_ts < l.ts) as prev_run
    from last l""",
)
def prev_run(spark, sf):
    return C.prev_run(lookups(spark, sf), "ts").select("user_id", text("prev_run").alias("prev_run"))


@query(
    "align_to_schedule",
    f"""with {SCHEDULE_CTE}
    select a.event_id, {stamp('a.slot_ts')} as prev_slot, {stamp('b.slot_ts')} as next_slot from
      (select event_id, slot_ts from events f asof left join slots s on s.event_type = f.event_type and s.slot_ts <= f.ts) a
    join (select event_id, slot_ts from events f asof left join slots s on s.event_type = f.event_type and s.slot_ts > f.ts) b
      on a.event_id = b.event_id""",
)
def align_to_schedule(spark, sf):
    facts = table(spark, sf, "events").select("event_id", "event_type", "ts")
    out = C.align_to_schedule(facts, event_schedules(spark, sf), "event_type", "ts")
    return out.select("event_id", text("prev_slot").alias("prev_slot"), text("next_slot").alias("next_slot"))


@query(
    "last_day_rules",
    """select o_orderkey, last_day(o_orderdate) = cast(o_orderdate as date) as by_reverse_day,
              last_day(o_orderdate) = cast(o_orderdate as date) as by_day_zero,
              last_day(o_orderdate) = cast(o_orderdate as date) as by_day_32 from orders""",
)
def last_day_rules(spark, sf):
    flags = C.last_day_rules(table(spark, sf, "orders"), "o_orderdate")
    return flags.select("o_orderkey", "by_reverse_day", "by_day_zero", "by_day_32")


@query(
    "normalise_schedules",
    f"""with {SCHEDULE_CTE}
    select event_type, position, array_to_string(minutes, ',') as minutes, array_to_string(hours, ',') as hours,
           array_to_string(days, ',') as days, array_to_string(rdays, ',') as rdays, array_to_string(wdays, ',') as wdays
    from sch""",
)
def normalise_schedules(spark, sf):
    rows = C.normalise_schedules(event_schedules(spark, sf), ["event_type"])
    lists = ["minutes", "hours", "days", "rdays", "wdays"]
    return rows.select("event_type", "position", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in lists])


@query(
    "shift_slots",
    f"""with {SCHEDULE_CTE}, r as (select event_type, min(d) as a, max(d) as z from e group by 1),
    s as (select event_type, slot_ts from slots join r using (event_type) where cast(slot_ts as date) between a and z)
    select event_type, {stamp('slot_ts')} as this_run,
           {stamp('lag(slot_ts) over w')} as prev_run, {stamp('lead(slot_ts, 2) over w')} as second_next
    from s window w as (partition by event_type order by slot_ts)""",
)
def shift_slots(spark, sf):
    slots = C.schedule_slots(event_schedules(spark, sf), ["event_type"], "first_ts", "last_ts")
    both = C.shift_slots(C.shift_slots(slots, ["event_type"], "slot_ts", -1, "p"), ["event_type"], "slot_ts", 2, "q")
    return both.select("event_type", text("slot_ts").alias("this_run"), text("p").alias("prev_run"), text("q").alias("second_next"))

"""Projections, filters, joins, aggregations, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import joins as J
from tidemark.operators import ordered as O
from tidemark.operators import predicates as P
from tidemark.operators import projection as Q
from workload.base import (
    CUT_NEW,
    HISTORY_CTE,
    IDS,
    day,
    history_image,
    history_target,
    money,
    query,
    stamp,
    table,
    text,
)

# Projections


@query("project_columns", "select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders")
def project_columns(spark, sf):
    return Q.project_columns(table(spark, sf, "orders"), leave_out=["o_totalprice", "o_orderdate"])


@query(
    "add_run_constants",
    "select c_custkey, c_name, '2021-01-01 00:00:00' as start_ts, '9999-12-31 23:59:59' as end_ts from customer",
)
def add_run_constants(spark, sf):
    rows = Q.add_run_constants(table(spark, sf, "customer").select("c_custkey", "c_name"), "2021-01-01 00:00:00")
    return rows.withColumn("start_ts", text("start_ts")).withColumn("end_ts", text("end_ts"))


@query(
    "case_simple",
    """select case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else 'other' end as state, count(*) as n
       from orders group by 1""",
)
def case_simple(spark, sf):
    state = F.expr("case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else 'other' end")
    return table(spark, sf, "orders").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(
    "case_searched",
    """select l_orderkey, l_linenumber, l_partkey,
              case when l_quantity >= 40 and l_discount > 0.05 then 'bulk' when l_quantity >= 40 then 'large' end as class
       from lineitem""",
)
def case_searched(spark, sf):
    big = F.col("l_quantity") >= 40
    label = F.when(big & (F.col("l_discount") > 0.05), "bulk").when(big, "large")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", label.alias("class"))


@query(
    "label_indented",
    """with words as (select p_partkey, p_brand, string_split(p_name, ' ') as w from part)
       select p_partkey, repeat(' ', 2 * len(w)) || p_brand || ' ' || array_to_string(w, ' ') as label from words""",
)
def label_indented(spark, sf):
    words = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_partkey", Q.label_indented(words, "p_brand", words).alias("label"))


# Filters


@query(
    "non_empty_list",
    """with l as (select user_id, list(distinct event_type) filter (value > 60) as errs
                  from events group by user_id)
       select user_id, len(errs) as n from l where errs is not null and len(errs) > 0""",
)
def non_empty_list(spark, sf):
    errors = F.collect_set(F.when(F.col("value") > 60, F.col("event_type")))
    lists = table(spark, sf, "events").groupBy("user_id").agg(errors.alias("errs"))
    return lists.where(P.non_empty("errs")).select("user_id", F.size("errs").cast("bigint").alias("n"))


@query(
    "similar_to",
    "select c_custkey, c_name from customer where regexp_full_match(c_name, 'Customer#0*[1-9][05]')",
)
def similar_to(spark, sf):
    return table(spark, sf, "customer").where(P.similar_to("c_name", "Customer#0*[1-9][05]")).select("c_custkey", "c_name")


CUST_LISTS = """select o_custkey, list(distinct o_orderstatus) as s, list(distinct o_orderpriority) as p from orders group by 1"""


@query(
    "contained_in",
    f"""with l as ({CUST_LISTS})
       select o_custkey, list_has_all(['F', 'O'], s) as only_fo, list_has_any(p, ['1-URGENT']) as urgent from l""",
)
def contained_in(spark, sf):
    lists = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.collect_set("o_orderstatus").alias("s"), F.collect_set("o_orderpriority").alias("p")
    )
    return lists.select(
        "o_custkey",
        P.contained_in("s", F.array(F.lit("F"), F.lit("O"))).alias("only_fo"),
        F.array_contains("p", "1-URGENT").alias("urgent"),
    )


@query(
    "in_list",
    """select o_orderkey from orders
       where o_orderpriority in ('1-URGENT', '2-HIGH') and (o_orderstatus = 'F' or o_totalprice between 100000 and 200000)""",
)
def in_list(spark, sf):
    cond = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (
        (F.col("o_orderstatus") == "F") | F.col("o_totalprice").between(100000, 200000)
    )
    return table(spark, sf, "orders").where(cond).select("o_orderkey")


@query(
    "directional",
    """select 1 as direction, o_orderkey from orders where o_orderdate >= timestamp '1999-06-15'
       union all select -1, o_orderkey from orders where o_orderdate <= timestamp '1999-06-15'""",
)
def directional(spark, sf):
    orders, at = table(spark, sf, "orders"), P.ntz("1999-06-15 00:00:00")
    one = lambda d: orders.where(P.directional("o_orderdate", at, d)).select(F.lit(d).alias("direction"), "o_orderkey")
    return one(1).unionByName(one(-1))


# Joins


@query(
    "join_inner",
    """select o_custkey, count(*) as n, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as amount
       from orders join lineitem on l_orderkey = o_orderkey group by o_custkey""",
)
def join_inner(spark, sf):
    joined = J.inner(table(spark, sf, "orders"), table(spark, sf, "lineitem"), {"o_orderkey": "l_orderkey"})
    return joined.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum(money("l_extendedprice")).cast("double").alias("amount")
    )


@query(
    "join_left_lookup",
    f"""with {HISTORY_CTE}, keys as (select distinct cust_id from tgt)
    select c_custkey, k.cust_id as known from customer left join keys k on k.cust_id = c_custkey""",
)
def join_left_lookup(spark, sf):
    history = history_target(spark, sf).withColumn("known", F.col("cust_id"))
    return J.left_lookup(table(spark, sf, "customer").select("c_custkey"), history, {"c_custkey": "cust_id"}, ["known"])


@query(
    "join_left",
    """select p_partkey, count(l_orderkey) as n from part left join lineitem
       on l_partkey = p_partkey and l_returnflag = 'R' and l_discount = 0.1 group by p_partkey""",
)
def join_left(spark, sf):
    part = table(spark, sf, "part")
    lines = table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_discount") == 0.1))
    counts = lines.groupBy("l_partkey").agg(F.count("*").alias("n"))
    joined = part.join(counts, part.p_partkey == counts.l_partkey, "left")
    return joined.select("p_partkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("anti_not_in", f"with {HISTORY_CTE} select * from img where (cust_id, priority) not in (select cust_id, priority from opened)")
def anti_not_in(spark, sf):
    return J.anti_not_in(history_image(spark, sf), P.valid_at(history_target(spark, sf), CUT_NEW), IDS)


@query("semi_in", f"with {HISTORY_CTE} select * from img where (cust_id, priority) in (select cust_id, priority from opened)")
def semi_in(spark, sf):
    return J.semi_in(history_image(spark, sf), P.valid_at(history_target(spark, sf), CUT_NEW), IDS)


@query(
    "in_or_in",
    f"""with {HISTORY_CTE} select * from img
        where (cust_id, priority) in (select cust_id, priority from closed)
           or (cust_id, priority) in (select cust_id, priority from upd)""",
)
def in_or_in(spark, sf):
    from tidemark.plans.history import diff_updates

    target, image = history_target(spark, sf), history_image(spark, sf)
    closed = target.where(F.col("end_ts") == P.ntz("1996-01-01 00:00:00"))
    return J.in_either(image, closed, diff_updates(target, image, IDS, CUT_NEW), IDS)


@query(
    "not_exists",
    """select c_custkey from customer where not exists (
       select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_totalprice > c_acctbal * 50)""",
)
def not_exists(spark, sf):
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    on = (orders.o_custkey == customer.c_custkey) & (orders.o_orderpriority == "1-URGENT") & (
        orders.o_totalprice > customer.c_acctbal * 50
    )
    return J.not_exists(customer, orders, on).select("c_custkey")


@query(
    "exists",
    """select p_partkey from part where exists (
       select 1 from lineitem where l_partkey = p_partkey and l_quantity >= p_size and l_returnflag = 'R')""",
)
def exists(spark, sf):
    part, lines = table(spark, sf, "part"), table(spark, sf, "lineitem")
    on = (lines.l_partkey == part.p_partkey) & (lines.l_quantity >= part.p_size) & (lines.l_returnflag == "R")
    return J.exists(part, lines, on).select("p_partkey")


@query(
    "null_safe_join",
    f"""with {HISTORY_CTE},
    a as (select size_class, status, count(*) as n_old from val group by all),
    b as (select size_class, status, count(*) as n_new from img group by all)
    select a.size_class, a.status, n_old, n_new from a join b
      on a.status = b.status and (a.size_class = b.size_class or a.size_class is null and b.size_class is null)""",
)
def null_safe_join(spark, sf):
    old = P.valid_at(history_target(spark, sf), CUT_NEW).groupBy("size_class", "status").agg(F.count("*").alias("n_old"))
    new = history_image(spark, sf).groupBy(F.col("size_class").alias("sc"), F.col("status").alias("st")).agg(
        F.count("*").alias("n_new")
    )
    joined = J.null_safe(old, new, {"size_class": "sc", "status": "st"})
    return joined.select("size_class", "status", "n_old", "n_new")


@query(
    "full_outer_merge",
    f"""with {HISTORY_CTE}
    select coalesce(i.cust_id, v.cust_id) as cust_id, coalesce(i.priority, v.priority) as priority,
           case when i.cust_id is not null then i.size_class else v.size_class end as size_class
    from img i full join val v on v.cust_id = i.cust_id and v.priority = i.priority""",
)
def full_outer_merge(spark, sf):
    old = P.valid_at(history_target(spark, sf), CUT_NEW)
    return J.full_outer_merge(history_image(spark, sf), old, IDS, "size_class")


@query(
    "cross_join",
    """with a as (select distinct l_returnflag from lineitem), b as (select distinct l_linestatus from lineitem),
            c as (select distinct l_linenumber from lineitem),
            n as (select l_returnflag, l_linestatus, l_linenumber, count(*) as n from lineitem group by all)
       select a.l_returnflag, b.l_linestatus, c.l_linenumber, coalesce(n.n, 0) as n
       from a cross join b cross join c left join n
         on n.l_returnflag = a.l_returnflag and n.l_linestatus = b.l_linestatus and n.l_linenumber = c.l_linenumber""",
)
def cross_join(spark, sf):
    codes = ["l_returnflag", "l_linestatus", "l_linenumber"]
    lines = table(spark, sf, "lineitem")
    counts = lines.groupBy(*codes).agg(F.count("*").alias("n"))
    grid = J.code_grid(counts, codes)
    return grid.join(counts, codes, "left").select(*codes, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query(
    "or_join",
    """select s_suppkey, count(*) as n from supplier join lineitem
       on l_suppkey = s_suppkey or l_partkey = s_suppkey group by s_suppkey""",
)
def or_join(spark, sf):
    supplier = table(spark, sf, "supplier").select("s_suppkey")
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("lines"))
    joined = J.or_join(supplier, lines, {"s_suppkey": "l_suppkey"}, {"s_suppkey": "l_partkey"})
    return joined.groupBy("s_suppkey").agg(F.sum("lines").alias("n"))


@query(
    "self_join_parent",
    """select c.p_partkey, p.p_name as parent_name, p.p_size as parent_size
       from part c left join part p on c.p_partkey > 0 and p.p_partkey = (c.p_partkey - 1) // 2""",
)
def self_join_parent(spark, sf):
    parent = F.when(F.col("p_partkey") > 0, F.floor((F.col("p_partkey") - 1) / 2))
    part = table(spark, sf, "part").withColumn("parent_id", parent)
    joined = J.self_join_parent(part, "p_partkey", "parent_id", {"parent_name": "p_name", "parent_size": "p_size"})
    return joined.select("p_partkey", "parent_name", "parent_size")


@query(
    "theta_array_join",
    """with s as (select event_type as schedule,
                         list(distinct hour(ts)) as hours, list(distinct isodow(ts)) as wdays
                  from events group by event_type)
       select event_id, schedule from events join s
       on list_contains(hours, hour(ts)) and list_contains(wdays, isodow(ts)) and schedule <> event_type""",
)
def theta_array_join(spark, sf):
    events = table(spark, sf, "events")
    hour, wday = F.hour("ts"), F.weekday("ts") + 1
    sets = events.groupBy(F.col("event_type").alias("schedule")).agg(
        F.collect_set(hour).alias("hours"), F.collect_set(wday).alias("wdays")
    )
    joined = J.theta_array_join(events, sets, {"hours": hour, "wdays": wday}, "hours")
    return joined.where(F.col("schedule") != F.col("event_type")).select("event_id", "schedule")


@query(
    "as_of_latest",
    """with e as (
         select event_id, event_type, value, case when event_id % 7 > 0 then user_id end as user_id,
                case when event_id % 11 > 0 then ts end as ts
         from events)
       select b.event_id, a.event_id as view_id, a.value as view_value
       from (select * from e where event_type = 'purchase') b
       asof left join (select * from e where event_type = 'view') a on a.user_id = b.user_id and a.ts <= b.ts""",
)
def as_of_latest(spark, sf):
    # Entries and facts without key or time are among them
    events = table(spark, sf, "events").withColumns(
        {"user_id": F.when(F.col("event_id") % 7 > 0, F.col("user_id")), "ts": F.when(F.col("event_id") % 11 > 0, F.col("ts"))}
    )
    buys = events.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    views = events.where(F.col("event_type") == "view")
    found = J.as_of_latest(
        buys, views, ["user_id"], "ts", {"view_id": "event_id", "view_value": "value"}, tie=["event_id"]
    )
    return found.select("event_id", "view_id", "view_value")


@query(
    "row_value_join",
    """with a as (select p_partkey, p_brand, string_split(p_name, ' ') as path from part),
            b as (select p_brand, string_split(p_name, ' ') as path, count(*) as n from part group by all)
       select p_partkey, n from a join b on (a.p_brand, a.path) = (b.p_brand, b.path)""",
)
def row_value_join(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", F.split("p_name", " ").alias("path"))
    counts = part.groupBy(F.col("p_brand").alias("b"), F.col("path").alias("q")).agg(F.count("*").alias("n"))
    return J.inner(part, counts, {"p_brand": "b", "path": "q"}).select("p_partkey", "n")


@query(
    "eav_pivot",
    """select user_id, max(value) filter (event_type = 'click') as click, max(value) filter (event_type = 'error') as error,
              max(value) filter (event_type = 'view') as view from events group by user_id""",
)
def eav_pivot(spark, sf):
    return J.eav_pivot(table(spark, sf, "events"), ["user_id"], "event_type", "value", ["click", "error", "view"])


@query(
    "scalar_subquery",
    """select o_orderkey, o_custkey from orders o
       where o_totalprice = (select max(o_totalprice) from orders i where i.o_custkey = o.o_custkey)""",
)
def scalar_subquery(spark, sf):
    return J.at_group_max(table(spark, sf, "orders"), ["o_custkey"], "o_totalprice").select("o_orderkey", "o_custkey")


@query(
    "range_between_join",
    """with cal as (select cast(d as date) as d from generate_series(timestamp '1995-01-01', timestamp '2001-12-31', interval 1 day) t(d))
       select o_orderkey, strftime(d, '%Y-%m-%d') as day from orders join cal
         on year(d) = year(o_orderdate) and month(d) = month(o_orderdate) and day(d) = day(o_orderdate)
       where o_orderdate >= timestamp '1996-07-01' and o_orderdate < timestamp '2000-07-01'""",
)
def range_between_join(spark, sf):
    from tidemark.operators.calendars import calendar_dim

    orders = table(spark, sf, "orders")
    bounds = orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    cal = calendar_dim(bounds, "a", "b").withColumns({"lo": P.ntz("1996-07-01 00:00:00"), "hi": P.ntz("2000-07-01 00:00:00")})
    return J.date_parts_join(orders, cal, "o_orderdate", "lo", "hi").select("o_orderkey", day("date").alias("day"))


# Aggregations


@query(
    "count_rows",
    f"""with {HISTORY_CTE}
    select 'inserted' as what, count(*) as n from ins union all select 'updated', count(*) from upd
    union all select 'deleted', count(*) from del""",
)
def count_rows(spark, sf):
    from tidemark.plans.history import classify_changes

    changes = classify_changes(history_target(spark, sf), history_image(spark, sf), IDS, CUT_NEW)
    names = F.when(F.col("op") == "I", "inserted").when(F.col("op") == "U", "updated").otherwise("deleted")
    return changes.where(F.col("op") != "=").groupBy(names.alias("what")).agg(F.count("*").alias("n"))


@query(
    "max_by_group",
    "select l_suppkey, nullif(l_returnflag, 'N') as flag, max(l_extendedprice) as top from lineitem group by all",
)
def max_by_group(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("N")))
    return A.max_by_group(lines, ["l_suppkey", "flag"], "l_extendedprice", "top")


@query("min_global", "select strftime(min(l_shipdate), '%Y-%m-%d') as first_day, min(l_discount) as low from lineitem")
def min_global(spark, sf):
    return table(spark, sf, "lineitem").agg(day(F.min("l_shipdate")).alias("first_day"), F.min("l_discount").alias("low"))


@query(
    "bool_connective",
    """select l_suppkey, l_linenumber,
              case when l_linenumber <= 2 then bool_or(l_quantity > 45)
                   when l_linenumber <= 4 then not bool_and(l_quantity > 3) else bool_and(l_quantity > 3) end as result
       from lineitem group by l_suppkey, l_linenumber""",
)
def bool_connective(spark, sf):
    n = F.col("l_linenumber")
    kind = F.when(n <= 2, "or").when(n <= 4, "not").otherwise("and")
    value = F.when(n <= 2, F.col("l_quantity") > 45).otherwise(F.col("l_quantity") > 3)
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", kind.alias("kind"), value.alias("v"))
    return lines.groupBy("l_suppkey", "l_linenumber").agg(A.connective(F.col("kind"), F.col("v")).alias("result"))


@query(
    "ordered_string_agg",
    """with f as (select o_custkey, o_orderpriority, min(o_orderdate) as first from orders group by 1, 2)
       select o_custkey, string_agg(o_orderpriority, ',' order by first, o_orderpriority) as priorities from f group by 1""",
)
def ordered_string_agg(spark, sf):
    first = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderdate").alias("first"))
    return A.ordered_string_agg(first, ["o_custkey"], ["first", "o_orderpriority"], "o_orderpriority", "priorities")


@query("distinct_rows", "select distinct l_partkey, l_suppkey from lineitem")
def distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query(
    "latest_per_key",
    f"""select user_id, event_id, event_type, {stamp('ts')} as ts from events
        qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
)
def latest_per_key(spark, sf):
    rows = table(spark, sf, "events").withColumn("at", F.col("ts"))
    return A.latest_per_key(rows, ["user_id"], ["at", "event_id"], ["event_id", "event_type", "ts"]).withColumn("ts", text("ts"))


@query(
    "group_having_count",
    "select l_orderkey, l_linenumber, count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1",
)
def group_having_count(spark, sf):
    return A.group_having_count(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "count_if_flags",
    """select o_custkey, bool_or(o_orderstatus = 'P') as any_partial, bool_and(o_orderstatus = 'F') as all_final,
              count(*) filter (o_totalprice > 300000) as n_large from orders group by o_custkey""",
)
def count_if_flags(spark, sf):
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.some(status == "P").alias("any_partial"),
        F.every(status == "F").alias("all_final"),
        F.count_if(F.col("o_totalprice") > 300000).alias("n_large"),
    )


# Windows


@query(
    "rank_zero_based",
    "select o_orderkey, rank() over (partition by o_custkey order by o_orderdate) - 1 as position from orders",
)
def rank_zero_based(spark, sf):
    ranked = O.rank(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate"], "r")
    return ranked.select("o_orderkey", (F.col("r") - 1).alias("position"))


@query(
    "dense_rank",
    "select o_orderkey, dense_rank() over (partition by o_orderpriority order by o_orderdate) as position from orders",
)
def dense_rank(spark, sf):
    ranked = O.rank(table(spark, sf, "orders"), ["o_orderpriority"], ["o_orderdate"], "position", dense=True)
    return ranked.select("o_orderkey", "position")


@query(
    "row_number_first",
    f"""with {HISTORY_CTE}
    select cust_id, priority, status, size_class from img
    qualify row_number() over (partition by cust_id order by size_class asc nulls first, priority) = 1""",
)
def row_number_first(spark, sf):
    return A.first_row(history_image(spark, sf), ["cust_id"], [F.col("size_class").asc_nulls_first(), "priority"])


@query(
    "running_sum",
    """select o_orderkey, cast(sum(o_orderkey) over (partition by o_orderpriority
         order by nullif(o_orderstatus, 'O') desc nulls last, o_orderkey rows between unbounded preceding and current row) as bigint) as total
       from orders""",
)
def running_sum(spark, sf):
    orders = table(spark, sf, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("O")))
    out = O.running_sum(orders, ["o_orderpriority"], [O.By("s", desc=True), "o_orderkey"], "o_orderkey", "total")
    return out.select("o_orderkey", "total")


@query(
    "top_n_per_group",
    """select o_custkey, o_orderkey, r from (
         select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_orderdate desc) as r from orders)
       where r <= 2""",
)
def top_n_per_group(spark, sf):
    ranked = A.top_n(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate").desc()], 2, "r")
    return ranked.select("o_custkey", "o_orderkey", "r")


@query(
    "row_number_as_path",
    """select o_orderkey, '[' || row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) || ']' as path from orders""",
)
def row_number_as_path(spark, sf):
    numbered = O.row_number(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "rn")
    path = F.array("rn")
    return numbered.select("o_orderkey", F.concat(F.lit("["), F.array_join(path.cast("array<string>"), ","), F.lit("]")).alias("path"))


# Sorting


@query("sort_multi", "select o_orderkey, o_orderpriority from orders order by o_orderpriority, o_orderkey desc")
def sort_multi(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return rows.orderBy("o_orderpriority", F.col("o_orderkey").desc())


@query(
    "sort_directional",
    "select o_orderkey, o_orderkey * -1 as k from orders order by k",
)
def sort_directional(spark, sf):
    direction = F.lit(-1).cast("bigint")
    return table(spark, sf, "orders").select("o_orderkey", (direction * F.col("o_orderkey")).alias("k")).orderBy("k")


@query(
    "top_k",
    """select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20""",
)
def top_k(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rows.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


@query(
    "nulls_ordering",
    f"""with {HISTORY_CTE}
    select cust_id, priority, size_class from img order by size_class desc nulls last, status asc nulls first, cust_id, priority""",
)
def nulls_ordering(spark, sf):
    rows = history_image(spark, sf)
    ordered = rows.orderBy(F.col("size_class").desc_nulls_last(), F.col("status").asc_nulls_first(), "cust_id", "priority")
    return ordered.select("cust_id", "priority", "size_class")


# Set operations


@query("union_all", f"with {HISTORY_CTE} select cust_id, priority, status from opened union all select cust_id, priority, status from img")
def union_all(spark, sf):
    old = P.valid_at(history_target(spark, sf), CUT_NEW)
    keep = ["cust_id", "priority", "status"]
    return old.select(*keep).unionByName(history_image(spark, sf).select(*keep))


@query("union_distinct", f"with {HISTORY_CTE} select cust_id, status from opened union select cust_id, status from img")
def union_distinct(spark, sf):
    old = P.valid_at(history_target(spark, sf), CUT_NEW).select("cust_id", "status")
    return old.unionByName(history_image(spark, sf).select("cust_id", "status")).distinct()


@query(
    "minus_by_key",
    "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderdate >= timestamp '2000-07-01')",
)
def minus_by_key(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey")
    late = table(spark, sf, "orders").where(F.col("o_orderdate") >= P.ntz("2000-07-01 00:00:00"))
    return J.anti_not_in(customer, late.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query(
    "intersect_by_key",
    """select distinct o_custkey from orders where o_orderpriority = '1-URGENT'
         and o_custkey in (select o_custkey from orders where o_orderpriority = '5-LOW')""",
)
def intersect_by_key(spark, sf):
    orders = table(spark, sf, "orders")
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT").select("o_custkey").distinct()
    return J.semi_in(urgent, orders.where(F.col("o_orderpriority") == "5-LOW"), ["o_custkey"])

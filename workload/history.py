"""Warehouse load methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import intervals as V
from tidemark.operators import predicates as P
from tidemark.operators import reshape as R
from tidemark.plans import history as H
from workload.base import (
    CUT_NEW,
    HISTORY_CTE,
    IDS,
    day,
    history_image,
    history_target,
    order_state,
    query,
    stamp,
    state_sql,
    table,
    text,
)


def shown(df):
    return df.select("cust_id", "priority", "status", "size_class", text("start_ts").alias("start_ts"),
                     text("end_ts").alias("end_ts"))


SHOWN = f"cust_id, priority, status, size_class, {stamp('start_ts')} as start_ts, {stamp('end_ts')} as end_ts"


@query("diff_deletes", f"with {HISTORY_CTE} select * from del")
def diff_deletes(spark, sf):
    return H.diff_deletes(history_target(spark, sf), history_image(spark, sf), IDS, CUT_NEW)


@query("diff_inserts", f"with {HISTORY_CTE} select * from ins")
def diff_inserts(spark, sf):
    return H.diff_inserts(history_target(spark, sf), history_image(spark, sf), IDS, CUT_NEW)


@query("diff_updates", f"with {HISTORY_CTE} select * from upd")
def diff_updates(spark, sf):
    return H.diff_updates(history_target(spark, sf), history_image(spark, sf), IDS, CUT_NEW)


@query(
    "classify_changes",
    f"""with {HISTORY_CTE}
    select cust_id, priority, 'D' as op from del union all
    select cust_id, priority, 'I' from ins union all
    select cust_id, priority, 'U' from upd union all
    select i.cust_id, i.priority, '=' from img i join val v using (cust_id, priority)
    where i.status is not distinct from v.status and i.size_class is not distinct from v.size_class""",
)
def classify_changes(spark, sf):
    changes = H.classify_changes(history_target(spark, sf), history_image(spark, sf), IDS, CUT_NEW)
    return changes.select(*IDS, "op")


@query(
    "scd2_apply",
    f"""with {HISTORY_CTE},
    gone as (select cust_id, priority from del union all select cust_id, priority from upd),
    kept as (
      select t.cust_id, t.priority, t.status, t.size_class, t.start_ts,
             case when g.cust_id is not null and timestamp '1999-01-01' >= t.start_ts
                       and timestamp '1999-01-01' < t.end_ts
                  then timestamp '1999-01-01' else t.end_ts end as end_ts
      from tgt t left join gone g on g.cust_id = t.cust_id and g.priority = t.priority),
    added as (select * from ins union all select * from upd)
    select {SHOWN} from kept union all
    select cust_id, priority, status, size_class, '1999-01-01 00:00:00', '9999-12-31 23:59:59' from added""",
)
def scd2_apply(spark, sf):
    return shown(H.scd2_apply(history_target(spark, sf), history_image(spark, sf), IDS, CUT_NEW))


@query(
    "close_versions",
    f"""with {HISTORY_CTE},
    gone as (select cust_id, priority from del union all select cust_id, priority from upd)
    select t.cust_id, t.priority, t.status, t.size_class, {stamp('t.start_ts')} as start_ts,
           case when g.cust_id is not null and timestamp '1999-01-01' >= t.start_ts
                     and timestamp '1999-01-01' < t.end_ts
                then '1999-01-01 00:00:00' else {stamp('t.end_ts')} end as end_ts
    from tgt t left join gone g on g.cust_id = t.cust_id and g.priority = t.priority""",
)
def close_versions(spark, sf):
    target, image = history_target(spark, sf), history_image(spark, sf)
    gone = H.diff_deletes(target, image, IDS, CUT_NEW).unionByName(
        H.diff_updates(target, image, IDS, CUT_NEW).select(*IDS)
    )
    return shown(H.close_versions(target, gone, IDS, CUT_NEW))


@query(
    "scd1_apply",
    f"""with {HISTORY_CTE}
    select cust_id, priority, status, size_class from img
    union all
    select cust_id, priority, status, size_class from opened o
    where not exists (select 1 from img i where i.cust_id = o.cust_id and i.priority = o.priority)""",
)
def scd1_apply(spark, sf):
    target = P.valid_at(history_target(spark, sf), CUT_NEW).drop("start_ts", "end_ts")
    return H.scd1_apply(target, history_image(spark, sf), IDS)


@query(
    "load_increment",
    """select o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate from orders""",
)
def load_increment(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    loaded = orders.where(F.col("o_orderdate") < P.ntz(CUT_NEW))
    feed = orders.unionByName(orders.where(F.col("o_orderstatus") == "P"))  # rows sent before, and repeats
    return H.load_increment(loaded, feed, ["o_orderkey"], "o_orderdate").withColumn("o_orderdate", day("o_orderdate"))


@query(
    "load_delta",
    f"""with base as ({state_sql("o_orderdate < timestamp '1999-01-01'")}),
    ops as (
      select o_custkey as cust_id, o_orderpriority as priority, o_orderstatus as status,
             case when o_totalprice < 150000 then 'SMALL' when o_totalprice < 350000 then 'MEDIUM' end as size_class,
             case o_orderstatus when 'F' then 'DELETE' when 'O' then 'INSERT' else 'UPDATE' end as op
      from orders where o_orderdate >= timestamp '1999-01-01'
      qualify row_number() over (partition by o_custkey, o_orderpriority
                                 order by o_orderdate desc, o_orderkey desc) = 1)
    select cust_id, priority, status, size_class from ops where op <> 'DELETE'
    union all
    select cust_id, priority, status, size_class from base b
    where not exists (select 1 from ops o where o.cust_id = b.cust_id and o.priority = b.priority)""",
)
def load_delta(spark, sf):
    orders = table(spark, sf, "orders")
    base = order_state(orders, None, CUT_NEW)
    size = F.when(F.col("o_totalprice") < 150000, "SMALL").when(F.col("o_totalprice") < 350000, "MEDIUM")
    op = F.when(F.col("o_orderstatus") == "F", "DELETE").when(F.col("o_orderstatus") == "O", "INSERT").otherwise("UPDATE")
    feed = orders.where(F.col("o_orderdate") >= P.ntz(CUT_NEW)).select(
        F.col("o_custkey").alias("cust_id"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        size.alias("size_class"),
        op.alias("op"),
        F.struct("o_orderdate", "o_orderkey").alias("seq"),
    )
    return H.load_delta(base, feed, IDS, "op", "seq")


# Customers: surrogates exist for those that ordered before 1996; a customer is current
# from the first to the last order.

KNOWN_SQL = """
  known as (select c_name, c_custkey + 100 as party_id from customer
            where c_custkey in (select o_custkey from orders where o_orderdate < timestamp '1996-01-01'))"""


def known_customers(spark, sf):
    old = table(spark, sf, "orders").where(F.col("o_orderdate") < P.ntz("1996-01-01 00:00:00"))
    customer = table(spark, sf, "customer")
    return customer.join(old, customer.c_custkey == old.o_custkey, "left_semi").select(
        F.col("c_name").alias("source_id"), (F.col("c_custkey") + 100).alias("party_id")
    )


@query(
    "assign_surrogate",
    f"""with {KNOWN_SQL}
    select c.c_name as source_id,
           coalesce(k.party_id, (select max(party_id) from known)
                    + row_number() over (partition by k.party_id is null order by c.c_name)) as party_id
    from customer c left join known k on k.c_name = c.c_name""",
)
def assign_surrogate(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_name").alias("source_id"))
    return H.assign_surrogate(rows, known_customers(spark, sf), ["source_id"], "party_id")


@query(
    "load_reference_entity",
    f"""with {KNOWN_SQL},
    window_ as (select o_custkey, min(o_orderdate) as a, max(o_orderdate) as b from orders group by o_custkey),
    cur as (select c_name, c_mktsegment, c_nationkey from customer join window_ on o_custkey = c_custkey
            where timestamp '2001-03-01' >= a and timestamp '2001-03-01' < b)
    select coalesce(k.party_id, (select max(party_id) from known)
                    + row_number() over (partition by k.party_id is null order by cur.c_name)) as party_id,
           '2001-03-01 00:00:00' as start_ts, '9999-12-31 23:59:59' as end_ts,
           cur.c_name as source_id, c_mktsegment as name, c_nationkey as nation
    from cur left join known k on k.c_name = cur.c_name""",
)
def load_reference_entity(spark, sf):
    span = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("admplod"), F.max("o_orderdate").alias("admnepo")
    )
    customer = table(spark, sf, "customer")
    stage = customer.join(span, customer.c_custkey == span.o_custkey)
    image = H.load_reference_entity(
        stage, known_customers(spark, sf), "c_name", "party_id", {"name": "c_mktsegment", "nation": "c_nationkey"},
        "2001-03-01 00:00:00", ("admplod", "admnepo"),
    )
    return image.withColumn("start_ts", text("start_ts")).withColumn("end_ts", text("end_ts"))


@query(
    "load_relationship",
    """with party as (
      select p_partkey as party_id, p_partkey as source_id, a as start_ts, b as end_ts
      from part join (select l_partkey, min(l_shipdate) a, max(l_shipdate) b from lineitem group by 1) on l_partkey = p_partkey),
    words as (select distinct unnest(string_split(p_name, ' ')) as w from part),
    activity as (select w as source_id, row_number() over (order by w) as activity_id from words),
    items as (select p_partkey, unnest(string_split(p_name, ' ')) as w,
                     cast(generate_subscripts(string_split(p_name, ' '), 1) as int) as order_num from part)
    select party_id, order_num, activity_id, '2001-07-01 00:00:00' as start_ts, '9999-12-31 23:59:59' as end_ts
    from items join party on party.source_id = p_partkey
         and timestamp '2001-07-01' >= party.start_ts and timestamp '2001-07-01' < party.end_ts
    join activity on activity.source_id = w""",
)
def load_relationship(spark, sf):
    part = table(spark, sf, "part")
    span = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.min("l_shipdate").alias("start_ts"), F.max("l_shipdate").alias("end_ts")
    )
    party = span.join(part, span.l_partkey == part.p_partkey).select(
        F.col("p_partkey").alias("party_id"), F.col("p_partkey").alias("source_id"), "start_ts", "end_ts"
    )
    items = R.split_ordered(part, ["p_partkey"], "p_name", " ", "code")
    codes = items.select(F.col("code").alias("source_id")).distinct()
    activity = H.dense_keys(codes, ["source_id"], "activity_id").select(
        "source_id", "activity_id", P.ntz("1990-01-01 00:00:00").alias("start_ts"), P.ntz(P.OPEN_END).alias("end_ts")
    )
    links = H.load_relationship(
        items, party, activity, "p_partkey", "code", "party_id", "activity_id", "2001-07-01 00:00:00"
    )
    return links.withColumn("start_ts", text("start_ts")).withColumn("end_ts", text("end_ts"))


# Yearly snapshots 1995 to 2001 folded into history.  The SQL finds versions as runs of
# equal attributes over the years in which a key is present.

YEARS = range(1995, 2002)

FOLD_SQL = f"""
  with snap as (
    select o_custkey as cust_id, o_orderpriority as priority, year(o_orderdate) as y, o_orderstatus as status,
           case when o_totalprice < 150000 then 'SMALL' when o_totalprice < 350000 then 'MEDIUM' end as size_class
    from orders
    qualify row_number() over (partition by o_custkey, o_orderpriority, year(o_orderdate)
                               order by o_orderdate desc, o_orderkey desc) = 1),
  marked as (
    select *, case when lag(y) over k = y - 1 and lag(status) over k is not distinct from status
                        and lag(size_class) over k is not distinct from size_class then 0 else 1 end as first
    from snap window k as (partition by cust_id, priority order by y)),
  runs as (select *, sum(first) over (partition by cust_id, priority order by y) as run from marked)
  select cust_id, priority, any_value(status) as status, any_value(size_class) as size_class,
         min(y) || '-01-01 00:00:00' as start_ts,
         case when max(y) = 2001 then '9999-12-31 23:59:59' else (max(y) + 1) || '-01-01 00:00:00' end as end_ts
  from runs group by cust_id, priority, run"""


def yearly_snapshots(spark, sf):
    orders = table(spark, sf, "orders")
    return [
        (f"{y}-01-01 00:00:00", order_state(orders, f"{y}-01-01 00:00:00", f"{y + 1}-01-01 00:00:00")) for y in YEARS
    ]


def empty_history(spark):
    return spark.createDataFrame(
        [], "cust_id bigint, priority string, status string, size_class string, start_ts timestamp_ntz, end_ts timestamp_ntz"
    )


@query("fold_snapshots", FOLD_SQL)
def fold_snapshots(spark, sf):
    return shown(H.fold_snapshots(empty_history(spark), yearly_snapshots(spark, sf), IDS))


@query("reload_from", FOLD_SQL)
def reload_from(spark, sf):
    snapshots = yearly_snapshots(spark, sf)
    # History loaded with a wrong image of 1999 and what followed; the reload must undo it.
    wrong = [(ts, image if ts < CUT_NEW else image.withColumn("status", F.lit("?"))) for ts, image in snapshots[:6]]
    loaded = H.fold_snapshots(empty_history(spark), wrong, IDS)
    return shown(H.reload_from(loaded, snapshots, IDS, CUT_NEW))


@query(
    "load_by_method",
    f"""with {HISTORY_CTE},
    gone as (select cust_id, priority from del union all select cust_id, priority from upd)
    select 'CRM' as source, t.cust_id, t.priority, t.status, t.size_class, {stamp('t.start_ts')} as start_ts,
           case when g.cust_id is not null and t.end_ts > timestamp '1999-01-01'
                then '1999-01-01 00:00:00' else {stamp('t.end_ts')} end as end_ts
    from tgt t left join gone g on g.cust_id = t.cust_id and g.priority = t.priority
    union all
    select 'CRM', cust_id, priority, status, size_class, '1999-01-01 00:00:00', '9999-12-31 23:59:59'
    from (select * from ins union all select * from upd)
    union all
    select 'ERP', cust_id, priority, status, size_class, '1999-01-01 00:00:00', '9999-12-31 23:59:59' from img
    union all
    select 'ERP', cust_id, priority, status, size_class, '1996-01-01 00:00:00', '9999-12-31 23:59:59' from opened o
    where not exists (select 1 from img i where i.cust_id = o.cust_id and i.priority = o.priority)
    union all
    select 'WEB', cust_id, priority, status, size_class, {stamp('start_ts')}, {stamp('end_ts')} from tgt""",
)
def load_by_method(spark, sf):
    history, image = history_target(spark, sf), history_image(spark, sf)
    crm = history.withColumn("source", F.lit("CRM"))
    erp = P.valid_at(history, CUT_NEW).withColumn("source", F.lit("ERP"))
    stamped = image.withColumn("start_ts", P.ntz(CUT_NEW)).withColumn("end_ts", P.ntz(P.OPEN_END))
    control = R.chunk_list(
        ["CRM", "SCD2", "cust_id,priority,start_ts", "ERP", "SCD1", "cust_id,priority"], ["Source", "Method", "IdList"]
    )
    web = history.withColumn("source", F.lit("WEB"))  # no control row names it
    out = H.load_by_method(crm.unionByName(erp).unionByName(web), {"CRM": image, "ERP": stamped}, control, CUT_NEW)
    return out.withColumn("start_ts", text("start_ts")).withColumn("end_ts", text("end_ts"))


@query(
    "join_as_of_version",
    f"""with {HISTORY_CTE}
    select i.cust_id, i.priority, i.status, v.status as old_status
    from img i join val v on v.cust_id = i.cust_id and v.priority = i.priority""",
)
def join_as_of_version(spark, sf):
    rows = history_image(spark, sf)
    versions = history_target(spark, sf).select(
        F.col("cust_id").alias("v_cust"), F.col("priority").alias("v_prio"), F.col("status").alias("old_status"),
        "start_ts", "end_ts",
    )
    joined = H.join_as_of_version(rows, versions, {"cust_id": "v_cust", "priority": "v_prio"}, CUT_NEW)
    return joined.select("cust_id", "priority", "status", "old_status")


@query(
    "join_version_range",
    f"""with {HISTORY_CTE}
    select o_orderkey, t.status as version_status, {stamp('t.start_ts')} as start_ts
    from orders left join tgt t on t.cust_id = o_custkey and t.priority = o_orderpriority
         and o_orderdate >= t.start_ts and o_orderdate < t.end_ts""",
)
def join_version_range(spark, sf):
    versions = history_target(spark, sf)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    joined = H.join_version_range(orders, versions, {"o_custkey": "cust_id", "o_orderpriority": "priority"}, "o_orderdate")
    return joined.select("o_orderkey", F.col("status").alias("version_status"), text("start_ts").alias("start_ts"))


@query(
    "join_versions",
    """select a.event_id, b.event_id as during from events a join events b on a.event_type = b.event_type
         and a.ts >= b.ts and a.ts < b.ts + to_minutes(b.user_id % 7)""",
)
def join_versions(spark, sf):
    """Events during others of their type: few keys, each with very many overlapping intervals."""
    events = table(spark, sf, "events")
    spans = events.select(F.col("event_id").alias("during"), F.col("event_type").alias("kind"), F.col("ts").alias("start_ts"),
                          (F.col("ts") + F.make_dt_interval(mins=F.col("user_id") % 7)).alias("end_ts"))
    found = V.join_versions(events.select("event_id", "event_type", "ts"), spans, {"event_type": "kind"}, "ts", unit=60)
    return found.select("event_id", "during")


@query("valid_at", f"with {HISTORY_CTE} select {SHOWN} from val")
def valid_at(spark, sf):
    return shown(P.valid_at(history_target(spark, sf), CUT_NEW))


@query(
    "changed",
    f"""with {HISTORY_CTE}
    select i.cust_id, i.priority,
           (i.status is distinct from v.status or i.size_class is distinct from v.size_class) as differs
    from img i join val v on v.cust_id = i.cust_id and v.priority = i.priority""",
)
def changed(spark, sf):
    old = P.valid_at(history_target(spark, sf), CUT_NEW).alias("old")
    new = history_image(spark, sf)
    differs = P.changed("old", "new", P.comparable(new, IDS, H.HIST)).alias("differs")
    return old.join(new.alias("new"), P.keys_match("old", "new", IDS)).select("new.cust_id", "new.priority", differs)


@query(
    "no_compare_columns",
    f"with {HISTORY_CTE} select count(*) as compared, 0 as differing from img i join val v using (cust_id, priority)",
)
def no_compare_columns(spark, sf):
    old = P.valid_at(history_target(spark, sf), CUT_NEW).select(*IDS).alias("old")
    new = history_image(spark, sf).select(*IDS)
    differs = P.changed("old", "new", P.comparable(new, IDS, H.HIST))
    pairs = old.join(new.alias("new"), P.keys_match("old", "new", IDS))
    return pairs.agg(F.count("*").alias("compared"), F.count_if(differs).cast("int").alias("differing"))


@query(
    "predicate_from_schema",
    f"""with {HISTORY_CTE}
    select i.cust_id, i.priority, i.status as new_status, v.status as old_status
    from img i join val v on v.cust_id = i.cust_id and v.priority = i.priority
    where i.status is distinct from v.status or i.size_class is distinct from v.size_class""",
)
def predicate_from_schema(spark, sf):
    target, new = history_target(spark, sf), history_image(spark, sf)
    on, differs = R.predicate_from_schema(target, IDS, list(H.HIST), "old", "new")
    joined = P.valid_at(target, CUT_NEW).alias("old").join(new.alias("new"), on).where(differs)
    return joined.select("new.cust_id", "new.priority", F.col("new.status").alias("new_status"),
                         F.col("old.status").alias("old_status"))

"""The event log read as a run log: a run per user, a status per event."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import hierarchy as T
from tidemark.operators import predicates as P
from tidemark.operators import runlog as L
from tidemark.session import settle
from workload.base import query, stamp, table, text
from workload.trees import TREE_CTE, part_tree

STATUS_SQL = """case event_type when 'view' then 'submitted' when 'click' then 'running' when 'purchase' then 'succeeded'
  when 'signup' then 'skipped' else case when value >= 60 then 'suspended' else 'failed' end end"""
LOG_CTE = f"""
  log as (select user_id, event_id, ts, cast(ts as date) as d, {STATUS_SQL} as status from events),
  cur as (select * from log qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1),
  daily as (select * from log qualify row_number() over (partition by user_id, d order by ts desc, event_id desc) = 1)"""


def run_log(spark, sf):
    return table(spark, sf, "events").select(
        "user_id", "event_id", "ts", F.to_date("ts").alias("d"), F.expr(STATUS_SQL).alias("status"), "value"
    )


def latest(log, keys):
    rows = log.withColumn("at", F.col("ts"))
    return L.current_status(rows, keys, ["at", "event_id"], ["event_id", "ts", "status"])


@query("current_status", f"with {LOG_CTE} select user_id, event_id, status, {stamp('ts')} as ts from cur")
def current_status(spark, sf):
    return latest(run_log(spark, sf), ["user_id"]).withColumn("ts", text("ts"))


@query(
    "eval_condition_leaf",
    f"""with {LOG_CTE}, first as (select user_id, status as required from log
          qualify row_number() over (partition by user_id order by ts, event_id) = 1)
    select user_id, required, status, case when status = required then 'run'
           when status in ('succeeded', 'skipped') then 'skip' else 'wait' end as verdict
    from first join cur using (user_id)""",
)
def eval_condition_leaf(spark, sf):
    log = run_log(spark, sf)
    first = log.groupBy("user_id").agg(F.min_by("status", F.struct("ts", "event_id")).alias("required"))
    joined = first.join(latest(log, ["user_id"]), "user_id")
    return joined.select("user_id", "required", "status", L.condition_verdict("required", "status").alias("verdict"))


# Leaves of the part tree take their verdict from the latest shipment of the part.
SHIPPED_CTE = f"""{TREE_CTE},
  flag as (select l_partkey, arg_max(l_returnflag, strftime(l_shipdate, '%Y%m%d') || l_returnflag) as f from lineitem group by 1),
  node as (select id, parent_id, case when kind <> 2 then case p_type when 'ECONOMY' then 'not' when 'SMALL' then 'or'
                                      when 'PROMO' then 'or' else 'and' end end as connective, f
           from tree left join flag on l_partkey = id)"""

# DuckDB evaluates the tree by the depth of each node.
DEPTHS = "depth as (select id, 0 as dep from tree where parent_id is null union all select t.id, dep + 1 from depth join tree t on t.parent_id = depth.id)"


def shipped_tree(spark, sf):
    lines = table(spark, sf, "lineitem")
    flag = lines.groupBy("l_partkey").agg(F.max(F.struct("l_shipdate", "l_returnflag")).alias("s"))
    flag = flag.select("l_partkey", F.col("s.l_returnflag").alias("f"))
    tree = part_tree(spark, sf)
    kind = F.when(F.col("p_type") == "ECONOMY", "not").when(F.col("p_type").isin("SMALL", "PROMO"), "or").otherwise("and")
    tree = tree.withColumn("connective", F.when(F.col("kind") != T.ATOM, kind))
    return tree.join(flag, F.col("id") == F.col("l_partkey"), "left").select("id", "parent_id", "connective", "f")


def heap_sql(leaf: str, combine: str, out: str) -> str:
    """The heap evaluated bottom-up: its children have the larger keys, so a fold over keys in
    descending order sees both children first."""
    return f"""with recursive {SHIPPED_CTE},
    arr as (select list(connective order by id) as c, list({leaf} order by id) as v, count(*) as n from node),
    f as (select n - 1 as i, v, c, n from arr
          union all
          select i - 1, case when c[i + 1] is null then v
                 else list_concat(list_concat(v[1:i], [{combine}]), v[i + 2:]) end, c, n
          from f where i >= 0)
    select unnest(range(0, n)) as id, unnest(list_transform(v, lambda x: {out})) as verdict from f where i = -1"""


KIDS = "case when 2 * i + 3 <= n then list_value(v[2 * i + 2], v[2 * i + 3]) else list_value(v[2 * i + 2]) end"


@query(
    "eval_condition_tree",
    heap_sql(
        "case f when 'A' then 3 when 'N' then 2 else 1 end",
        f"case when c[i + 1] = 'or' then list_max({KIDS}) else list_min({KIDS}) end",
        "case x when 3 then 'run' when 2 then 'wait' else 'skip' end",
    ),
)
def eval_condition_tree(spark, sf):
    leaf = F.when(F.col("f") == "A", "run").when(F.col("f") == "N", "wait").otherwise("skip")
    nodes = shipped_tree(spark, sf).withColumn("verdict", F.when(F.col("connective").isNull(), leaf)).drop("f")
    return L.eval_condition_tree(nodes, "id", "parent_id", "connective", "verdict").select("id", "verdict")


@query(
    "eval_boolean_tree",
    heap_sql(
        "case when f = 'A' then 1 else 0 end",
        f"case c[i + 1] when 'or' then list_max({KIDS}) when 'not' then 1 - list_min({KIDS}) else list_min({KIDS}) end",
        "x = 1",
    ),
)
def eval_boolean_tree(spark, sf):
    nodes = shipped_tree(spark, sf).withColumn("verdict", F.when(F.col("connective").isNull(), F.col("f") == "A")).drop("f")
    return L.eval_boolean_tree(nodes, "id", "parent_id", "connective", "verdict").select("id", "verdict")


@query(
    "rollup_parallel",
    f"""with {LOG_CTE}, g as (select user_id as caller, list(distinct status) as s from daily group by user_id
                              union all select -day(d), list(distinct status) from daily group by d)
    select caller, case when list_contains(s, 'running') or (list_contains(s, 'submitted') and len(s) > 1) then 'running'
                        when list_contains(s, 'submitted') then 'submitted' when list_contains(s, 'failed') then 'failed'
                        when list_contains(s, 'suspended') then 'suspended' when list_contains(s, 'succeeded') then 'succeeded'
                        else 'skipped' end as status from g""",
)
def rollup_parallel(spark, sf):
    daily = latest(run_log(spark, sf), ["user_id", "d"])
    by_user = L.rollup_parallel(daily, ["user_id"], "status").withColumnRenamed("user_id", "caller")
    by_day = L.rollup_parallel(daily.withColumn("caller", -F.dayofmonth("d").cast("bigint")), ["caller"], "status")
    return by_user.unionByName(by_day)


SEQ_TABLE = "[" + ", ".join(
    "[" + ", ".join("null" if b is None else str(L.STATUSES.index(b) + 1) for b in L.IN_SEQUENCE[a]) + "]" for a in L.STATUSES
) + "]"


@query(
    "rollup_sequence",
    f"""with m as (select o_custkey, year(o_orderdate)::int as y, o_orderkey,
                          case o_orderstatus when 'F' then case when o_orderpriority = '5-LOW' then 6 else 5 end
                               when 'P' then 2 else 1 end as s from orders),
    l as (select o_custkey, y, list(s order by case s when 5 then 0 when 6 then 0 when 2 then 1 else 2 end, o_orderkey) as s
          from m group by o_custkey, y),
    r as (select o_custkey, y, list_reduce(list_reverse(s), lambda acc, x: {SEQ_TABLE}[x][acc]) as v from l)
    select o_custkey, y, ['submitted', 'running', 'failed', 'suspended', 'succeeded', 'skipped'][v] as status from r""",
)
def rollup_sequence(spark, sf):
    done = F.when(F.col("o_orderpriority") == "5-LOW", "skipped").otherwise("succeeded")
    status = F.when(F.col("o_orderstatus") == "F", done).when(F.col("o_orderstatus") == "P", "running").otherwise("submitted")
    place = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    members = table(spark, sf, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("y"), place.alias("place"), "o_orderkey", status.alias("s")
    )
    return L.rollup_sequence(members, ["o_custkey", "y"], ["place", "o_orderkey"], "s")


ADMIT_CTE = """
  w as (select o_orderkey, o_orderpriority, cast(o_totalprice / 1000 as int) as importance,
               case when o_orderstatus = 'F' then null else 1 + day(o_orderdate) end as load from orders where o_orderstatus <> 'P'),
  u as (select o_orderpriority, sum(day(o_orderdate)) as taken from orders where o_orderstatus = 'P' group by 1),
  cap as (select o_orderpriority, case when o_orderpriority <> '5-LOW' then cast(sum(day(o_orderdate)) * 0.75 as bigint) end as capacity
          from orders group by 1)"""


def admission(spark, sf):
    """Orders that wait for their priority, what runs already, and the capacities."""
    orders = table(spark, sf, "orders").withColumn("dom", F.dayofmonth("o_orderdate"))
    load = F.when(F.col("o_orderstatus") != "F", F.col("dom") + 1)
    importance = F.round(F.col("o_totalprice") / 1000).cast("int")
    waiting = orders.where(F.col("o_orderstatus") != "P").select(
        "o_orderkey", "o_orderpriority", importance.alias("importance"), load.alias("load")
    )
    used = orders.where(F.col("o_orderstatus") == "P").select("o_orderpriority", F.col("dom").alias("load"))
    limit = F.when(F.col("o_orderpriority") != "5-LOW", F.round(F.sum("dom") * F.expr("0.75bd")).cast("bigint"))
    return waiting, used, orders.groupBy("o_orderpriority").agg(limit.alias("capacity"))


@query(
    "admit_by_capacity",
    f"""with {ADMIT_CTE},
    s as (select w.*, sum(coalesce(load, 1)) over (partition by o_orderpriority
            order by importance desc nulls last, load asc nulls first, o_orderkey
            rows between unbounded preceding and current row) as load_sum from w)
    select o_orderkey, cast(load_sum as bigint) as load_sum from s join cap using (o_orderpriority) left join u using (o_orderpriority)
    where capacity is null or load_sum <= capacity - coalesce(taken, 0)""",
)
def admit_by_capacity(spark, sf):
    waiting, used, capacity = admission(spark, sf)
    admitted = L.admit_by_capacity(waiting, capacity, "o_orderpriority", "o_orderkey", "importance", "load", used=used)
    return admitted.select("o_orderkey", "load_sum")


@query(
    "admit_greedy",
    f"""with {ADMIT_CTE},
    free as (select o_orderpriority, cast(capacity - coalesce(taken, 0) as bigint) as free from cap left join u using (o_orderpriority)),
    runs as (select o_orderpriority, list(struct_pack(id := cast(o_orderkey as bigint), size := cast(coalesce(load, 1) as bigint), free := cast(0 as bigint),
                       upto := cast(0 as bigint), fits := false)
                     order by importance desc nulls last, load asc nulls first, o_orderkey) as l
             from w group by o_orderpriority),
    -- One run after the other; the last entry of the list so far says what is left
    tried as (select list_reduce(list_transform(l, lambda x: [x]), lambda done, x: done || [struct_pack(
                       id := x[1].id, size := x[1].size,
                       free := case when x[1].size <= done[-1].free then done[-1].free - x[1].size else done[-1].free end,
                       upto := case when x[1].size <= done[-1].free then done[-1].upto + x[1].size else done[-1].upto end,
                       fits := x[1].size <= done[-1].free)],
                     [struct_pack(id := cast(-1 as bigint), size := cast(0 as bigint), free := coalesce(free, 9000000000000000000),
                                  upto := cast(0 as bigint), fits := false)]) as t
              from runs left join free using (o_orderpriority))
    select x.id as o_orderkey, x.upto as load_sum from (select unnest(t) as x from tried) where x.fits""",
)
def admit_greedy(spark, sf):
    waiting, used, capacity = admission(spark, sf)
    admitted = L.admit_greedy(waiting, capacity, "o_orderpriority", "o_orderkey", "importance", "load", used=used)
    return admitted.select("o_orderkey", "load_sum")


@query(
    "overdue",
    f"""with {LOG_CTE}, lim as (select * from (values ('running', 30), ('submitted', 120), ('failed', 5)) as v(s, minutes))
    select user_id, status, minutes as limit_minutes,
           cast(floor((epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(ts)) / 1000000) as bigint) as seconds
    from cur join lim on s = status
    where ts + to_minutes(cast(minutes as bigint)) < timestamp '2024-01-31 00:00:00'""",
)
def overdue(spark, sf):
    limits = spark.createDataFrame([("running", 30), ("submitted", 120), ("failed", 5)], "status string, minutes int")
    current = latest(run_log(spark, sf), ["user_id"])
    late = L.overdue(current, limits, "status", "ts", P.ntz("2024-01-31 00:00:00"))
    return late.select("user_id", "status", "limit_minutes", "seconds")


FINAL_SQL = ", ".join(f"'{s}'" for s in L.FINAL)


@query(
    "timed_verdict",
    f"""with {LOG_CTE}
    select user_id, r.required, case when status = r.required and timestamp '2024-01-31 00:00:00' > ts + interval 12 hours then 'run'
                when status in ({FINAL_SQL}) and r.required not in ({FINAL_SQL}) then 'skip' else 'wait' end as verdict
    from cur, (values ('running'), ('succeeded')) as r(required)""",
)
def timed_verdict(spark, sf):
    current = latest(run_log(spark, sf), ["user_id"]).withColumn("required", F.explode(F.array(F.lit("running"), F.lit("succeeded"))))
    verdict = L.timed_verdict(F.col("required"), F.col("status"), F.col("ts"), P.ntz("2024-01-31 00:00:00"), F.expr("interval 12 hours"))
    return current.select("user_id", "required", verdict.alias("verdict"))


ALLOWED_SQL = ", ".join(f"('{a or 'none'}', '{b}')" for a, b in L.TRANSITIONS)


@query(
    "illegal_transitions",
    f"""with {LOG_CTE}, s as (select event_id, user_id, lag(status) over (partition by user_id order by ts, event_id) as previous, status from log)
    select * from s where (coalesce(previous, 'none'), status) not in ({ALLOWED_SQL})""",
)
def illegal_transitions(spark, sf):
    bad = L.illegal_transitions(run_log(spark, sf), ["user_id"], ["ts", "event_id"], "status")
    return bad.select("event_id", "user_id", "previous", "status")


@query(
    "retry_state",
    f"""with {LOG_CTE}, f as (select event_id, ts, row_number() over (partition by user_id order by ts, event_id) as attempt
                              from log where status = 'failed')
    select event_id, attempt, case when attempt <= 3 then 'submit same' when attempt <= 5 then 'fail caller' else 'suspend' end as action,
           case when attempt <= 3 then {stamp('ts + interval 5 minute')} when attempt <= 5 then {stamp('ts + interval 60 minute')} end as retry_at
    from f""",
)
def retry_state(spark, sf):
    policy = [L.Retry(3, "submit same", 5), L.Retry(2, "fail caller", 60)]
    out = L.retry_state(
        run_log(spark, sf), ["user_id"], ["ts", "event_id"], F.col("status") == "failed", "ts", policy, "suspend"
    )
    return out.select("event_id", "attempt", "action", text("retry_at").alias("retry_at"))


@query(
    "prefix_gate",
    f"""with r as (select l_suppkey, date_trunc('month', o_orderdate) as slot, l_linenumber, min(o_orderdate) as started, max(l_shipdate) as ended
                   from lineitem join orders on o_orderkey = l_orderkey group by all),
    last as (select l_suppkey, slot, arg_max(ended, l_linenumber) as e from r group by all),
    g as (select l_suppkey, slot, lag(e) over (partition by l_suppkey order by slot) as gate from last)
    select r.l_suppkey, {stamp('r.slot')} as slot, l_linenumber, {stamp('started')} as started, {stamp('gate')} as gate
    from r join g on g.l_suppkey = r.l_suppkey and g.slot = r.slot where started < gate""",
)
def prefix_gate(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    slot = F.trunc("o_orderdate", "MM").cast("timestamp_ntz").alias("slot")
    runs = settle(joined.groupBy("l_suppkey", slot, "l_linenumber").agg(
        F.min("o_orderdate").alias("started"), F.max("l_shipdate").alias("ended")
    ))
    early = L.prefix_gate(runs, ["l_suppkey"], "slot", "l_linenumber", "started", "ended")
    return early.select("l_suppkey", text("slot").alias("slot"), "l_linenumber", text("started").alias("started"),
                        text("gate").alias("gate"))


SIZE_STATUS = """case when p_size < 8 then 'submitted' when p_size < 16 then 'running' when p_size < 24 then 'failed'
  when p_size < 32 then 'suspended' when p_size < 40 then 'succeeded' else 'skipped' end"""


@query(
    "eval_pattern_condition",
    f"""with i as (select p_brand as name, string_split(p_name, ' ') as ident, {SIZE_STATUS} as st from part),
    c as (select distinct name || ' ' || ident[1] || ' * not running' as id, name, [ident[1], '*'] as pat, 'running' as st, true as neg from i
          union all select distinct name || ' * ' || ident[2] || ' succeeded', name, ['*', ident[2]], 'succeeded', false from i where st = 'succeeded'
          union all select distinct name || ' * * not failed', name, ['*', '*'], 'failed', true from i
          union all select distinct name || ' * nothing not running', name, ['*', 'nothing'], 'running', true from i),
    j as (select c.id, c.neg, c.st, i.st as actual, i.name is not null as hit from c left join i
          on i.name = c.name and len(i.ident) = 2 and (pat[1] = '*' or pat[1] = ident[1]) and (pat[2] = '*' or pat[2] = ident[2]))
    select id, count(*) filter (hit) as matches,
           case when any_value(neg) then count(*) filter (hit and actual = st) = 0
                else count(*) filter (hit) > 0 and count(*) filter (hit and actual = st) = count(*) filter (hit) end as holds
    from j group by id""",
)
def eval_pattern_condition(spark, sf):
    instances = table(spark, sf, "part").select(
        F.col("p_brand").alias("name"), F.split("p_name", " ").alias("identifier"), F.expr(SIZE_STATUS).alias("status")
    )
    instances = instances.select("name", "identifier", "status")
    star, word = F.lit("*"), lambda i: F.get("identifier", F.lit(i))

    def condition(rows, pattern, status, negated):
        shown = F.concat_ws(" ", "name", F.array_join(F.array(*pattern), " "), F.lit(("not " if negated else "") + status))
        return rows.select(shown.alias("id"), "name", F.array(*pattern).alias("pattern"), F.lit(status).alias("status"),
                           F.lit(negated).alias("negated")).distinct()

    conditions = condition(instances, [word(0), star], "running", True)
    conditions = conditions.unionByName(
        condition(instances.where(F.col("status") == "succeeded"), [star, word(1)], "succeeded", False)
    )
    conditions = conditions.unionByName(condition(instances, [star, star], "failed", True))
    conditions = conditions.unionByName(condition(instances, [star, F.lit("nothing")], "running", True))
    return L.eval_pattern_condition(instances, conditions)

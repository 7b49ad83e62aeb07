"""Table maintenance and merges by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import predicates as P
from tidemark.plans import tables as K
from workload.base import (
    CUT_NEW,
    HISTORY_CTE,
    IDS,
    history_image,
    history_target,
    query,
    table,
)
from workload.history import FOLD_SQL, empty_history, shown, yearly_snapshots

ORDER = ["o_orderkey", "o_custkey", "o_orderstatus"]
ORDER_SQL = "o_orderkey, o_custkey, o_orderstatus"


@query("drop_if_exists", f"select {ORDER_SQL} from orders")
def drop_if_exists(spark, sf):
    orders = table(spark, sf, "orders").select(*ORDER)
    name = K.work_table(spark, "once")
    K.create_from_query(name, orders.withColumn("o_orderstatus", F.lit("?")))
    K.drop_if_exists(spark, name)
    K.drop_if_exists(spark, name)
    return K.create_from_query(name, orders)


@query(
    "drop_matching",
    """select 'base' as suffix, count(*) as n from orders
       union all select 'T1', count(*) from orders where o_orderstatus = 'O'""",
)
def drop_matching(spark, sf):
    orders = table(spark, sf, "orders").select(*ORDER)
    name = K.work_table(spark, "link")
    database, base = name.split(".")
    parts = {"": orders, "_T01": orders, "_t02": orders, "_T1": orders.where(F.col("o_orderstatus") == "O")}
    for suffix, rows in parts.items():
        K.create_from_query(name + suffix, rows)
    K.drop_matching(spark, database, base)
    left = [s for s in parts if spark.catalog.tableExists(name + s)]
    counted = [
        spark.table(name + s).agg(F.lit(s.lstrip("_") or "base").alias("suffix"), F.count("*").alias("n")) for s in left
    ]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


@query("create_like_empty", f"select {ORDER_SQL} from orders")
def create_like_empty(spark, sf):
    orders = table(spark, sf, "orders").select(*ORDER)
    name = K.work_table(spark, "image")
    empty = K.create_like_empty(spark, name, orders)
    K.append(name, orders)
    return empty


@query("ctas", "select o_custkey, count(*) as n from orders group by o_custkey")
def ctas(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return K.create_from_query(K.work_table(spark, "counts"), rows)


@query("append", f"select {ORDER_SQL} from orders")
def append(spark, sf):
    orders = table(spark, sf, "orders").select(*ORDER)
    name = K.work_table(spark, "grown")
    K.create_from_query(name, orders.where(F.col("o_orderstatus") == "F"))
    K.append(name, orders.where(F.col("o_orderstatus") != "F").select(*reversed(ORDER)))
    return spark.table(name)


@query("full_reload", f"select {ORDER_SQL} from orders")
def full_reload(spark, sf):
    orders = table(spark, sf, "orders").select(*ORDER)
    name = K.work_table(spark, "reloaded")
    K.create_from_query(name, orders.withColumn("o_orderstatus", F.lit("?")))
    K.full_reload(name, orders)
    return spark.table(name)


MERGE_CTE = f"""with {HISTORY_CTE}, base as (select cust_id, priority, status, size_class from opened)"""


def merge_sides(spark, sf):
    base = P.valid_at(history_target(spark, sf), CUT_NEW).drop("start_ts", "end_ts")
    return base, history_image(spark, sf)


@query(
    "upsert_by_natural_key",
    f"""{MERGE_CTE}
    select i.*, case when b.cust_id is null then 'inserted' else 'updated' end as op
    from img i left join base b on b.cust_id = i.cust_id and b.priority = i.priority
    union all
    select b.*, 'kept' from base b
    where not exists (select 1 from img i where i.cust_id = b.cust_id and i.priority = b.priority)""",
)
def upsert_by_natural_key(spark, sf):
    base, image = merge_sides(spark, sf)
    return K.upsert(base, image, IDS)


@query(
    "reload_by_key",
    f"""{MERGE_CTE}
    select * from base where cust_id not in (select cust_id from img) union all select * from img""",
)
def reload_by_key(spark, sf):
    base, image = merge_sides(spark, sf)
    return K.reload_by_key(base, image, ["cust_id"])


@query(
    "flag_active",
    f"""{MERGE_CTE}
    select b.*, exists (select 1 from img i where i.cust_id = b.cust_id and i.priority = b.priority) as active from base b
    union all select i.*, true from ins i""",
)
def flag_active(spark, sf):
    base, image = merge_sides(spark, sf)
    return K.flag_active(base.withColumn("active", F.lit(True)), image, IDS)


@query(
    "relink_parent",
    """select p_partkey + 1000000 as id, case when p_partkey = 0 then null else (p_partkey - 1) // 2 + 1000000 end as parent_id
       from part""",
)
def relink_parent(spark, sf):
    part = table(spark, sf, "part")
    name = F.concat(F.lit("task "), F.col("p_partkey").cast("string"))
    identifier = F.array("p_brand", "p_type")
    feed = part.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") > 0, F.floor((F.col("p_partkey") - 1) / 2)).alias("parent_id"),
        name.alias("name"), identifier.alias("identifier"),
    )
    instances = part.select(
        (F.col("p_partkey") + 1000000).alias("id"), F.lit(None).cast("bigint").alias("parent_id"),
        name.alias("name"), identifier.alias("identifier"),
    )
    return K.relink_parent(instances, feed, ["name", "identifier"]).select("id", "parent_id")


PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "note"]


@query(
    "collect_stats",
    "select * from ("
    + " union all ".join(
        f"select '{c}' as name, count(*) as n_rows, count(*) - count({c}) as n_nulls, count(distinct {c}) as n_distinct from o"
        for c in PROFILED
    ).join(["(with o as (select *, nullif(o_orderstatus, 'O') as note from orders) ", "))"]),
)
def collect_stats(spark, sf):
    orders = table(spark, sf, "orders").withColumn("note", F.nullif("o_orderstatus", F.lit("O")))
    name = K.work_table(spark, "measured")
    K.create_from_query(name, orders.select(*PROFILED))
    K.collect_stats(spark, name)
    return K.column_profile(spark.table(name), PROFILED, exact=True)


@query("apply_to_history", FOLD_SQL)
def apply_to_history(spark, sf):
    name = K.work_table(spark, "history")
    K.create_history(spark, name, empty_history(spark).schema)
    for ts, image in yearly_snapshots(spark, sf):
        K.apply_to_history(spark, name, image, IDS, ts)
    return shown(spark.table(name))


@query("apply_to_history_rerun", FOLD_SQL)
def apply_to_history_rerun(spark, sf):
    """Every load runs three times: with a wrong image, the right one, and the right one again."""
    name = K.work_table(spark, "history")
    K.create_history(spark, name, empty_history(spark).schema)
    for ts, image in yearly_snapshots(spark, sf):
        for run in (image.withColumn("status", F.lit("?")).where(F.col("cust_id") % 3 > 0), image, image):
            K.apply_to_history(spark, name, run, IDS, ts)
    return shown(spark.table(name))

"""Key, reference, rule and arity audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audit as A
from tidemark.operators.reshape import text_to_list
from workload.base import query, table


@query(
    "audit_unique",
    "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
)
def audit_unique(spark, sf):
    return A.audit_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "audit_orphans",
    """select o_orderkey, o_custkey from orders where not exists (
       select 1 from customer where c_custkey = o_custkey and c_acctbal > 0 and c_mktsegment <> 'BUILDING')""",
)
def audit_orphans(spark, sf):
    known = table(spark, sf, "customer").where((F.col("c_acctbal") > 0) & (F.col("c_mktsegment") != "BUILDING"))
    return A.audit_orphans(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), known, {"o_custkey": "c_custkey"})


@query(
    "audit_check",
    """select event_id, event_type from events
       where not ((event_type = 'error' and value <= 100) or (event_type <> 'error' and value > 5)
                  or case when user_id > 50 then null else false end)""",
)
def audit_check(spark, sf):
    is_error = F.col("event_type") == "error"
    unknown = F.when(F.col("user_id") > 50, F.lit(None).cast("boolean")).otherwise(False)
    check = (is_error & (F.col("value") <= 100)) | (~is_error & (F.col("value") > 5)) | unknown
    return A.audit_check(table(spark, sf, "events"), check).select("event_id", "event_type")


@query(
    "audit_arity",
    """select p_partkey, len(string_split(p_name, ' ')) as n_values from part
       where len(string_split(p_name, ' ')) <> case when p_type in ('PROMO', 'LARGE') then 3 else 2 end""",
)
def audit_arity(spark, sf):
    names = F.when(F.col("p_type").isin("PROMO", "LARGE"), F.array(*[F.lit(x) for x in "abc"])).otherwise(
        F.array(*[F.lit(x) for x in "ab"])
    )
    part = table(spark, sf, "part").select("p_partkey", names.alias("names"), text_to_list("p_name", " ").alias("given"))
    return A.audit_arity(part, "names", "given").select("p_partkey", F.size("given").cast("bigint").alias("n_values"))

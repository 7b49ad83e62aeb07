"""Registry of queries with their SQL twins, and the images several families share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``name``; ``sql`` is the equivalent DuckDB text."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table; its schema is read from a footer once, not on every use."""
    path = f"{sf}/{name}.parquet"
    if path not in SCHEMAS:
        SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[path]).parquet(path)


def text(c: str | Column) -> Column:
    """Second-precision text of a timestamp, so that both engines hash the same value."""
    return F.substring((F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz").cast("string"), 1, 19)


def day(c: str | Column) -> Column:
    return F.to_date(c).cast("string")


def money(c: str | Column) -> Column:
    """Exact decimal of an amount: sums do not depend on the order of addition."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


# Order states.  One row per (customer, priority) with the attributes of its latest order
# in a period; consecutive periods give images with new, vanished, returning, changed
# and NULL-valued keys.

IDS = ["cust_id", "priority"]

CUT_OPEN = "1996-01-01 00:00:00"
CUT_NEW = "1999-01-01 00:00:00"


def order_state(orders: DataFrame, lo: str | None, hi: str | None) -> DataFrame:
    at = F.col("o_orderdate")
    if lo:
        orders = orders.where(at >= F.lit(lo).cast("timestamp_ntz"))
    if hi:
        orders = orders.where(at < F.lit(hi).cast("timestamp_ntz"))
    size = F.when(F.col("o_totalprice") < 150000, "SMALL").when(F.col("o_totalprice") < 350000, "MEDIUM")
    last = F.max_by(F.struct(F.col("o_orderstatus").alias("status"), size.alias("size_class")),
                    F.struct("o_orderdate", "o_orderkey"))
    return (
        orders.groupBy(F.col("o_custkey").alias("cust_id"), F.col("o_orderpriority").alias("priority"))
        .agg(last.alias("s"))
        .select("cust_id", "priority", "s.status", "s.size_class")
    )


def history_target(spark: SparkSession, sf: str) -> DataFrame:
    """Closed versions for 1995 and versions open since 1996."""
    orders = table(spark, sf, "orders")
    span = lambda df, a, b: df.withColumn("start_ts", F.lit(a).cast("timestamp_ntz")).withColumn(
        "end_ts", F.lit(b).cast("timestamp_ntz")
    )
    closed = span(order_state(orders, None, CUT_OPEN), "1995-01-01 00:00:00", CUT_OPEN)
    opened = span(order_state(orders, CUT_OPEN, CUT_NEW), CUT_OPEN, "9999-12-31 23:59:59")
    return closed.unionByName(opened)


def history_image(spark: SparkSession, sf: str) -> DataFrame:
    return order_state(table(spark, sf, "orders"), CUT_NEW, None)


def state_sql(where: str) -> str:
    return f"""
      select o_custkey as cust_id, o_orderpriority as priority, o_orderstatus as status,
             case when o_totalprice < 150000 then 'SMALL' when o_totalprice < 350000 then 'MEDIUM' end as size_class
      from orders where {where}
      qualify row_number() over (partition by o_custkey, o_orderpriority
                                 order by o_orderdate desc, o_orderkey desc) = 1"""


HISTORY_CTE = f"""
  closed as ({state_sql("o_orderdate < timestamp '1996-01-01'")}),
  opened as ({state_sql("o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1999-01-01'")}),
  img as ({state_sql("o_orderdate >= timestamp '1999-01-01'")}),
  tgt as (select *, timestamp '1995-01-01' as start_ts, timestamp '1996-01-01' as end_ts from closed
          union all
          select *, timestamp '1996-01-01', timestamp '9999-12-31 23:59:59' from opened),
  val as (select * from tgt where timestamp '1999-01-01' >= start_ts and timestamp '1999-01-01' < end_ts),
  del as (select cust_id, priority from val v
          where not exists (select 1 from img i where i.cust_id = v.cust_id and i.priority = v.priority)),
  ins as (select * from img i
          where not exists (select 1 from val v where v.cust_id = i.cust_id and v.priority = i.priority)),
  upd as (select i.* from img i join val v on v.cust_id = i.cust_id and v.priority = i.priority
          where i.status is distinct from v.status or i.size_class is distinct from v.size_class)
"""

STAMP = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


def stamp(c: str) -> str:
    return STAMP.format(c=c)

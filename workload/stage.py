"""Extracts, snapshots and their maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans import tables as K
from tidemark.session import new_folder
from tidemark.sources import extracts as X
from tidemark.sources import stage as S
from workload.base import day, query, table

def note():
    """Empty text, NULL, and text with separator and quotes."""
    return F.when(F.col("o_orderstatus") == "F", "").when(F.col("o_orderstatus") == "P", 'a;"b" c').alias("note")


NOTE_SQL = "case o_orderstatus when 'F' then '' when 'P' then 'a;\"b\" c' end as note"


def ddl(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


@query(
    "read_extract",
    f"""select o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate,
               o_orderpriority, {NOTE_SQL} from orders""",
)
def read_extract(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderpriority",
        note(),
    )
    path = new_folder(spark, "extract")
    X.write_extract(orders, path)
    return X.read_extract(spark, path, orders.schema).withColumn("o_orderdate", day("o_orderdate"))


@query(
    "read_extract_encoded",
    "select c_custkey, c_name, translate(c_mktsegment, 'ACERSZOU', 'ÁČĚŘŠŽŐŮ') as segment from customer",
)
def read_extract_encoded(spark, sf):
    customer = table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.translate("c_mktsegment", "ACERSZOU", "ÁČĚŘŠŽŐŮ").alias("segment")
    )
    path = new_folder(spark, "extract")
    X.write_extract(customer, path, encoding="WIN1250")
    return X.read_extract(spark, path, customer.schema, encoding="WIN1250")


@query(
    "read_control_dsv",
    f"""select o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, {NOTE_SQL} from orders""",
)
def read_control_dsv(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("o_orderdate"), note()
    )
    path = new_folder(spark, "control")
    X.write_control_dsv(orders, path)
    return X.read_control_dsv(spark, path, orders.schema).withColumn("o_orderdate", day("o_orderdate"))


ROW = "o_orderkey, o_custkey, o_orderstatus"
LOAD_SQL = "year(o_orderdate) * 10000000000 + 101000000"


def yearly(spark, sf):
    load = F.year("o_orderdate").cast("bigint") * 10000000000 + 101000000
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", load.alias("_load_id"))


def staged(spark, sf):
    """A stage table with one snapshot per order year."""
    rows = yearly(spark, sf)
    name = K.work_table(spark, "orders")
    S.create_stage(spark, name, rows.schema)
    rows.write.insertInto(name)
    return name


def load(year: int) -> int:
    return year * 10000000000 + 101000000


@query("scan_snapshot", f"select {ROW}, {LOAD_SQL} as _load_id from orders where year(o_orderdate) = 1998")
def scan_snapshot(spark, sf):
    return S.scan_snapshot(spark, staged(spark, sf), load(1998))


@query("scan_all_snapshots", f"select {ROW}, {LOAD_SQL} as _load_id from orders")
def scan_all_snapshots(spark, sf):
    return S.scan_all_snapshots(spark, staged(spark, sf))


@query(
    "list_snapshots",
    f"select _load_id, cast(rank() over (order by _load_id desc) as int) as recency from (select distinct {LOAD_SQL} as _load_id from orders)",
)
def list_snapshots(spark, sf):
    return S.list_snapshots(spark, staged(spark, sf))


@query(
    "rank_recency",
    """select d as load_day, cast(rank() over (order by d desc) as int) as recency
       from (select distinct strftime(l_shipdate, '%Y-%m-%d') as d from lineitem)""",
)
def rank_recency(spark, sf):
    days = table(spark, sf, "lineitem").select(day("l_shipdate").alias("load_day"))
    return S.rank_recency(days, "load_day")


@query(
    "list_columns",
    """select ordinal, name, n_filled from (
       select 1 as ordinal, 'o_orderkey' as name, count(o_orderkey) as n_filled from orders union all
       select 2, 'o_custkey', count(o_custkey) from orders union all
       select 3, 'o_orderstatus', count(o_orderstatus) from orders)""",
)
def list_columns(spark, sf):
    rows = yearly(spark, sf)
    columns = X.list_columns(rows)
    filled = K.column_profile(rows, [c for c in rows.columns if c != S.LOAD])
    filled = filled.select("name", (F.col("n_rows") - F.col("n_nulls")).alias("n_filled"))
    return columns.join(filled, "name").select("ordinal", "name", "n_filled")


@query(
    "read_lookup_values",
    """select code, meaning, count(o_orderkey) as n_orders
       from (values ('F', 'finished'), ('O', 'open'), ('P', 'partial'), ('X', 'unknown')) as v(code, meaning)
       left join orders on o_orderstatus = code group by code, meaning""",
)
def read_lookup_values(spark, sf):
    codes = X.lookup_values(
        spark, "code string, meaning string", [("F", "finished"), ("O", "open"), ("P", "partial"), ("X", "unknown")]
    )
    counts = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    joined = codes.join(counts, F.col("code") == F.col("o_orderstatus"), "left")
    return joined.select("code", "meaning", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_orders"))


@query(
    "land_snapshot",
    f"""select o_orderkey, o_custkey, case when year(o_orderdate) = 1997 then 'R' else o_orderstatus end as o_orderstatus,
               {LOAD_SQL} as _load_id from orders""",
)
def land_snapshot(spark, sf):
    name = staged(spark, sf)
    again = yearly(spark, sf).where(F.col("_load_id") == load(1997)).withColumn("o_orderstatus", F.lit("R"))
    S.land_snapshot(spark, name, again.drop("_load_id"), load(1997))
    return spark.table(name)


@query(
    "carry_forward",
    f"""select {ROW}, {LOAD_SQL} as _load_id from orders
        union all select {ROW}, 20020101000000 from orders where year(o_orderdate) = 2001""",
)
def carry_forward(spark, sf):
    name = staged(spark, sf)
    missing = new_folder(spark, "absent")
    S.load_or_carry(spark, name, load(2002), lambda: spark.read.parquet(missing))
    return spark.table(name)


@query("prune_snapshots", f"select {ROW}, {LOAD_SQL} as _load_id from orders where year(o_orderdate) >= 1998")
def prune_snapshots(spark, sf):
    name = staged(spark, sf)
    S.prune_snapshots(spark, name, 4)
    return spark.table(name)

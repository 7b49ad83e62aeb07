"""Catalog tables: work tables, merges by natural key, history rewritten in place."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.predicates import OPEN_END, ntz, similar_to
from tidemark.plans.history import HIST, one_row_per_key, scd2_apply, scd2_insert
from tidemark.session import new_folder, overwrite_partitions

WORK = "tidemark_work"


def work_database(spark: SparkSession) -> str:
    """Database for work tables, kept in the shared folder."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {WORK} LOCATION '{new_folder(spark, 'tables')}'")
    return WORK


def work_table(spark: SparkSession, label: str) -> str:
    """A table name not used before."""
    return f"{work_database(spark)}.{label}_{uuid.uuid4().hex[:12]}"


def drop_if_exists(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_matching(spark: SparkSession, database: str, name: str) -> list[str]:
    """Drop the temporary work tables ``<name>_T01`` and so on."""
    tables = spark.sql(f"SHOW TABLES IN {database}").where(similar_to("tableName", f"\\Q{name}\\E_[Tt][0-9]{{2}}"))
    dropped = [r["tableName"] for r in tables.collect()]
    for t in dropped:
        drop_if_exists(spark, f"{database}.{t}")
    return dropped


def create_like_empty(spark: SparkSession, name: str, like: DataFrame) -> DataFrame:
    """An empty table with the columns of another one."""
    like.limit(0).write.saveAsTable(name)
    return spark.table(name)


def create_from_query(name: str, rows: DataFrame) -> DataFrame:
    rows.write.saveAsTable(name)
    return rows.sparkSession.table(name)


def append(name: str, rows: DataFrame) -> None:
    """Insert by column name; missing columns fail."""
    columns = rows.sparkSession.table(name).columns
    rows.select(*columns).write.insertInto(name)


def full_reload(name: str, rows: DataFrame) -> None:
    rows.select(*rows.sparkSession.table(name).columns).write.insertInto(name, overwrite=True)


def upsert(target: DataFrame, feed: DataFrame, natural: Sequence[str]) -> DataFrame:
    """Update matching rows, add missing ones, keep the rest; ``op`` says which."""
    rest = [c for c in target.columns if c not in natural]
    old_side = target.select(*natural, F.struct(*rest).alias("old"))
    new_side = one_row_per_key(feed, natural).select(*natural, F.struct(*rest).alias("new"))
    op = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept").otherwise("updated")
    joined = old_side.join(new_side, list(natural), "full_outer")
    return joined.select(*natural, F.coalesce("new", "old").alias("row"), op.alias("op")).select(*natural, "row.*", "op")


def reload_by_key(target: DataFrame, feed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace all rows of every key that occurs in the feed."""
    return target.join(feed.select(*keys), list(keys), "left_anti").unionByName(feed)


def flag_active(target: DataFrame, current: DataFrame, natural: Sequence[str], flag: str = "active") -> DataFrame:
    """Mark rows whose key is in the new set, add unseen keys; nothing is deleted."""
    rest = [c for c in target.columns if c not in natural and c != flag]
    old_side = target.select(*natural, F.struct(*rest).alias("old"))
    new_side = one_row_per_key(current, natural).select(*natural, F.struct(*rest).alias("new"))
    joined = old_side.join(new_side, list(natural), "full_outer")
    return joined.select(
        *natural, F.coalesce("old", "new").alias("row"), F.col("new").isNotNull().alias(flag)
    ).select(*natural, "row.*", flag)


def relink_parent(instances: DataFrame, feed: DataFrame, natural: Sequence[str]) -> DataFrame:
    """Resolve parents through natural keys.

    ``feed`` has its own ``id`` and ``parent_id`` next to the natural key; ``instances``
    has the permanent ``id``.  Three equi joins, the natural key matched null-safely.
    """
    child, parent = feed.alias("c"), feed.alias("p")
    named = child.join(parent, F.col("c.parent_id") == F.col("p.id"), "left").select(
        *[F.col(f"c.{k}").alias(f"c_{k}") for k in natural], *[F.col(f"p.{k}").alias(f"p_{k}") for k in natural],
        F.col("p.id").isNotNull().alias("has_parent"),
    )
    permanent = instances.select(F.col("id").alias("new_parent"), *[F.col(k).alias(f"q_{k}") for k in natural])
    found = named.join(permanent, [F.col("has_parent"), *[F.col(f"p_{k}").eqNullSafe(F.col(f"q_{k}")) for k in natural]], "left")
    links = found.select(*[F.col(f"c_{k}").alias(f"l_{k}") for k in natural], "new_parent", F.lit(True).alias("fed"))
    joined = instances.join(links, [F.col(k).eqNullSafe(F.col(f"l_{k}")) for k in natural], "left")
    parent_id = F.when(F.col("fed"), F.col("new_parent")).otherwise(F.col("parent_id"))
    return joined.select(*[parent_id.alias(c) if c == "parent_id" else F.col(c) for c in instances.columns])


def collect_stats(spark: SparkSession, name: str) -> None:
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def column_profile(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """Rows, NULLs and distinct values per column in one pass.

    Distinct values are estimated by default; exact counting shuffles every value.
    """
    count = F.count_distinct if exact else F.approx_count_distinct
    entries = [
        F.struct(
            F.lit(c).alias("name"),
            F.count("*").alias("n_rows"),
            F.count_if(F.col(c).isNull()).alias("n_nulls"),
            count(c).alias("n_distinct"),
        )
        for c in columns
    ]
    return df.agg(F.array(*entries).alias("p")).select(F.inline("p"))


# History kept in place.  ``closed_load`` partitions it: 0 holds the open versions, any
# other number the versions closed by that load.  One dynamic overwrite replaces the
# open partition and writes this load's closed one; older ones are never touched.

CLOSED = "closed_load"


def create_history(spark: SparkSession, name: str, schema: T.StructType) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, {CLOSED} BIGINT) USING parquet PARTITIONED BY ({CLOSED})")


def load_number(ts: str) -> int:
    return int("".join(ch for ch in ts if ch.isdigit()))


def history_parts(spark: SparkSession, name: str) -> list[int]:
    """Numbers of the partitions of a stored history, from the catalog."""
    parts = spark.sql(f"SHOW PARTITIONS {name}").select(F.regexp_extract("partition", rf"{CLOSED}=(\d+)", 1).cast("bigint").alias("p"))
    return sorted(r["p"] for r in parts.collect())


def rewrite_history(spark: SparkSession, name: str, versions: DataFrame, parts: Sequence[int], hist=HIST) -> None:
    """Replace the partitions ``parts`` of a stored history by ``versions``, which lie in no others.

    A dynamic overwrite stages its files and moves them once the job is done, so it may read the
    partitions it replaces.  It leaves absent partitions alone, so those without a version are dropped after it.
    """
    digits = F.translate(F.substring(F.col(hist[1]).cast("string"), 1, 19), "-: ", "").cast("bigint")
    out = versions.withColumn(CLOSED, F.when(F.col(hist[1]) == ntz(OPEN_END), F.lit(0).cast("bigint")).otherwise(digits))
    seen = Observation()
    counted = [F.count_if(F.col(CLOSED) == p).alias(f"p{p}") for p in parts]
    overwrite_partitions(name, out.observe(seen, *counted))
    for p in parts:
        if not seen.get[f"p{p}"]:
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({CLOSED}={p})")


def insert_into_history(
    spark: SparkSession, name: str, image: DataFrame, ids: Sequence[str], ts: str, until: str | None, hist=HIST
) -> None:
    """Bring a load that comes late, or again, into a stored history; see ``scd2_insert``.

    Only what was closed by this load or later ones, and the open versions, is read and written.
    """
    load_id = load_number(ts)
    parts = {p for p in history_parts(spark, name) if p >= load_id} | {0, load_id} | ({load_number(until)} if until else set())
    stored = spark.table(name).where(F.col(CLOSED).isin(*parts)).drop(CLOSED)
    rewrite_history(spark, name, scd2_insert(stored, image, ids, ts, until, OPEN_END, hist), sorted(parts), hist)


def apply_to_history(spark: SparkSession, name: str, image: DataFrame, ids: Sequence[str], ts: str, hist=HIST) -> None:
    """Bring a stored history up to date with a new image at ``ts``.

    The same load may run again, with the same image or a corrected one: what it closed is read next to
    the open versions and the load is undone before it is applied.  A load older than the newest is refused.
    """
    load_id = load_number(ts)
    newest = max(history_parts(spark, name), default=0)
    if newest > load_id:
        raise ValueError(f"load {load_id} is older than load {newest}; reload the history from there on")
    stored = spark.table(name).where(F.col(CLOSED).isin(0, load_id)).drop(CLOSED)
    rewrite_history(spark, name, scd2_apply(stored, image, ids, ts, OPEN_END, hist), [0, load_id], hist)

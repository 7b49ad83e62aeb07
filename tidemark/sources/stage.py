"""Stage tables: one Parquet table per source, one partition per load."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import overwrite_partitions
from tidemark.sources.extracts import data_schema

LOAD = "_load_id"

log = logging.getLogger(__name__)


def create_stage(spark: SparkSession, name: str, schema: T.StructType) -> None:
    """Create the stage table if it is not there; the load number partitions it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data_schema(schema).fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, {LOAD} BIGINT) USING parquet PARTITIONED BY ({LOAD})")


def land_snapshot(spark: SparkSession, name: str, rows: DataFrame, load_id: int) -> None:
    """Replace one snapshot.  An empty extract leaves an empty snapshot, not a missing one.

    New files are moved in when all are written, so a load that fails leaves the snapshot as it
    was, and ``rows`` may come from that very snapshot.
    """
    columns = [c for c in spark.table(name).columns if c != LOAD]
    seen = Observation()
    landed = rows.select(*columns, F.lit(int(load_id)).cast("bigint").alias(LOAD))
    overwrite_partitions(name, landed.observe(seen, F.count("*").alias("n")))
    if not seen.get["n"]:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({LOAD}={int(load_id)})")
    spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION ({LOAD}={int(load_id)})")


def scan_snapshot(spark: SparkSession, name: str, load_id: int) -> DataFrame:
    """One snapshot; prunes to its partition."""
    return spark.table(name).where(F.col(LOAD) == F.lit(int(load_id)).cast("bigint"))


def scan_all_snapshots(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def list_snapshots(spark: SparkSession, name: str) -> DataFrame:
    """Load numbers with their recency rank, newest first; read from the catalog, not the data."""
    ids = spark.sql(f"SHOW PARTITIONS {name}").select(
        F.regexp_extract("partition", rf"{LOAD}=(\d+)", 1).cast("bigint").alias(LOAD)
    )
    return rank_recency(ids, LOAD)


def rank_recency(ids: DataFrame, column: str) -> DataFrame:
    """Rank of distinct load numbers, newest = 1.

    The numbers are gathered into one sorted array: there is one per run, however
    many rows each run loaded.
    """
    newest = F.sort_array(F.collect_set(column), asc=False)
    return ids.agg(newest.alias("all")).select(F.posexplode("all").alias("__i", column)).select(
        column, (F.col("__i") + 1).alias("recency")
    )


def previous_snapshot(spark: SparkSession, name: str, load_id: int) -> int | None:
    row = list_snapshots(spark, name).where(F.col(LOAD) < int(load_id)).agg(F.max(LOAD).alias("m")).first()
    return row["m"]


def carry_forward(spark: SparkSession, name: str, load_id: int) -> int | None:
    """Copy the previous snapshot under a new load number; nothing to copy is not an error."""
    before = previous_snapshot(spark, name, load_id)
    if before is None:
        return None
    land_snapshot(spark, name, scan_snapshot(spark, name, before), load_id)
    return before


def load_or_carry(
    spark: SparkSession, name: str, load_id: int, read: Callable[[], DataFrame], attempts: int = 1, wait: float = 0
) -> str:
    """Land what ``read()`` returns, or carry the last snapshot forward if it cannot be read.

    Returns "loaded", "carried", or "skipped" when there is nothing to carry either.
    """
    for attempt in range(1, attempts + 1):
        try:
            land_snapshot(spark, name, read(), load_id)
            return "loaded"
        except (AnalysisException, FileNotFoundError) as error:  # anything but an extract that isn't there fails
            if isinstance(error, AnalysisException) and error.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("extract for %s %s not loaded, attempt %s: %s", name, load_id, attempt, error)
            if attempt < attempts:
                time.sleep(wait)
    return "skipped" if carry_forward(spark, name, load_id) is None else "carried"


def refresh_stage(
    spark: SparkSession,
    name: str,
    load_id: int,
    read: Callable[[], DataFrame],
    retention: int = 14,
    attempts: int = 3,
    wait: float = 300,
) -> str:
    """The whole stage load: land or carry, refresh the new snapshot's statistics, prune."""
    outcome = load_or_carry(spark, name, load_id, read, attempts, wait)
    if outcome != "skipped":
        spark.sql(f"ANALYZE TABLE {name} PARTITION ({LOAD}={int(load_id)}) COMPUTE STATISTICS")
    prune_snapshots(spark, name, retention)
    return outcome


def prune_snapshots(spark: SparkSession, name: str, retention: int) -> list[int]:
    """Drop snapshots beyond the newest ``retention``; a failure is logged and left for the next run."""
    old = [r[LOAD] for r in list_snapshots(spark, name).where(F.col("recency") > retention).collect()]
    for load_id in old:
        try:
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({LOAD}={int(load_id)})")
        except Exception as error:
            log.warning("snapshot %s of %s not dropped: %s", load_id, name, error)
    return old

"""Extracts arriving as files, landed and merged by Structured Streaming.

Extracts lie in folders ``_load_id=<yyyyMMddHHmmss>``.  The stream only notices new
files, by their listing alone; what is loaded is the whole extract of each load that has news, replacing its
snapshot.  A batch that runs twice, or an extract that arrives in pieces, therefore
ends in the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.tables import apply_to_history, insert_into_history
from tidemark.session import overwrite_partitions
from tidemark.sources.extracts import read_extract
from tidemark.sources.stage import LOAD, create_stage, land_snapshot

LAST = "tidemark.last_load"
#: What the reader of whole files offers; only what is selected is read, and contents never are.
LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def load_folder(root: str, load_id: int) -> str:
    return f"{root.rstrip('/')}/{LOAD}={int(load_id)}"


def on_new_loads(
    spark: SparkSession, root: str, checkpoint: str, handle: Callable[[int], None], files_per_batch: int | None = None
) -> StreamingQuery:
    """Call ``handle`` for every load that has new files, oldest first, then stop."""
    source = spark.readStream.format("binaryFile").schema(f"{LISTING}, {LOAD} bigint")
    if files_per_batch is not None:
        source = source.option("maxFilesPerTrigger", files_per_batch)

    def batch(rows: DataFrame, _: int) -> None:
        for row in rows.select(LOAD).distinct().orderBy(LOAD).collect():  # one row per load
            handle(row[LOAD])

    return (
        source.load(root).select(LOAD).writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_land(
    spark: SparkSession, root: str, checkpoint: str, name: str, schema: T.StructType, files_per_batch: int | None = None, **options
) -> StreamingQuery:
    """Land arriving extracts in a stage table, one snapshot per load."""
    create_stage(spark, name, schema)

    def handle(load_id: int) -> None:
        land_snapshot(spark, name, read_extract(spark, load_folder(root, load_id), schema, **options), load_id)

    return on_new_loads(spark, root, checkpoint, handle, files_per_batch)


def last_load(spark: SparkSession, name: str) -> int:
    """Number of the last load applied to a history table, 0 if none."""
    found = spark.sql(f"SHOW TBLPROPERTIES {name}").where(F.col("key") == LAST).first()
    return int(found["value"]) if found else 0


def load_time(load_id: int) -> str:
    d = str(load_id)
    return f"{d[:4]}-{d[4:6]}-{d[6:8]} {d[8:10]}:{d[10:12]}:{d[12:14]}"


# The manifest of a history: which files, by name, size and time, each load was made of when it was applied.


def manifest_of(name: str) -> str:
    return f"{name}_manifest"


def create_manifest(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {manifest_of(name)} (path STRING, size BIGINT, modified TIMESTAMP, {LOAD} BIGINT) "
              f"USING parquet PARTITIONED BY ({LOAD})")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """The files that lie in all loads now."""
    files = spark.read.format("binaryFile").option("basePath", root).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col(LOAD).cast("bigint").alias(LOAD))


def prints(files: DataFrame) -> DataFrame:
    """One number per load that tells sets of files apart, whatever their order."""
    one = F.xxhash64("path", "size", F.unix_micros("modified"))
    return files.groupBy(LOAD).agg(F.struct(F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(one).alias("x")).alias("print"))


def changed_loads(spark: SparkSession, root: str, name: str) -> list[int]:
    """Loads in the manifest whose files are no longer those they were applied with, and that have files; oldest first."""
    then = prints(spark.table(manifest_of(name))).select(F.col(LOAD).alias("l"), F.col("print").alias("then"))
    now = prints(listed(spark, root))
    moved = now.join(then, F.col(LOAD) == F.col("l")).where(F.col("print") != F.col("then"))
    return sorted(r[LOAD] for r in moved.select(LOAD).collect())  # one row per load


def stream_scd2(
    spark: SparkSession,
    root: str,
    checkpoint: str,
    name: str,
    schema: T.StructType,
    ids: Sequence[str],
    late: str = "stop",
    **options,
) -> StreamingQuery:
    """Keep a history table up to date, load by load.

    A missing row means a deleted key.  Which files a load had, with their sizes and times, is recorded in a manifest after the
    history is written, and a load seen again with the same files is skipped.  When another piece of the last load arrives,
    that load is undone and applied again with all its pieces.

    Anything new about an earlier load is news about the past.  With ``late="stop"`` it stops the stream.  With
    ``late="insert"`` the load is brought in between the loads before and after it, so that every order of
    arrival ends in the same history; files rewritten under their old names, which a stream of files does not notice, are then found
    by the manifest before the stream starts.
    """
    if late not in ("stop", "insert"):
        raise ValueError(f"late is stop or insert, not {late}")
    create_manifest(spark, name)
    manifest = manifest_of(name)

    def applied() -> list[int]:
        parts = spark.sql(f"SHOW PARTITIONS {manifest}").select(F.regexp_extract("partition", rf"{LOAD}=(\d+)", 1).cast("bigint").alias("p"))
        return sorted(r["p"] for r in parts.collect())

    def handle(load_id: int) -> None:
        extract = read_extract(spark, load_folder(root, load_id), schema, **options)
        mine = F.col(LOAD) == F.lit(load_id).cast("bigint")
        files = listed(spark, root).where(mine)
        known = applied()
        if load_id in known and prints(files).select("print").first() == prints(spark.table(manifest).where(mine)).select("print").first():
            return
        last = max([*known, last_load(spark, name)])
        if load_id >= last:
            apply_to_history(spark, name, extract, ids, load_time(load_id))
            spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{LAST}' = '{load_id}')")
        elif late == "stop":
            raise ValueError(f"a piece of load {load_id} came after load {last} was applied")
        else:
            until = min(x for x in [*known, last] if x > load_id)
            insert_into_history(spark, name, extract, ids, load_time(load_id), load_time(until))
        overwrite_partitions(manifest, files)

    if late == "insert":
        for load_id in changed_loads(spark, root, name):
            handle(load_id)
    return on_new_loads(spark, root, checkpoint, handle)

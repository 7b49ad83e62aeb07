"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", app: str = "tidemark", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tidemark-warehouse-"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="tidemark-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage.

    Spark takes a join to be as large as its sides multiplied and keeps that estimate with the table, so from round to round it
    has twice as many digits, until they fill the driver.  One that is beyond any size is dropped.
    """
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    plan = out._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes() >= 1 << 63:
        out = DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), out._jdf.schema(), False), spark)
    return out


def settle_any(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """``settle``, and how many rows meet ``condition``; seen while writing, at no extra pass."""
    seen = Observation()
    out = settle(df.observe(seen, F.count_if(condition).alias("n")))
    return out, seen.get["n"]


#: Tables that rounds add to are written as one when they are more than this, so that plans don't grow from round to round.
PIECES = 6


def add_piece(pieces: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """``pieces`` of one table with another; all but the first, which often is the largest, are put together when they are many."""
    pieces = [*pieces, new]
    return pieces if len(pieces) <= PIECES else [pieces[0], settle(reduce(DataFrame.unionByName, pieces[1:]))]


def slices(spark: SparkSession) -> int:
    """Number of slices for an explicit range partitioning."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_MODE = threading.Lock()


def overwrite_partitions(name: str, rows: DataFrame) -> None:
    """Replace only the partitions that occur in ``rows``.

    ``insertInto`` takes the mode from the session alone and writes before it returns; the
    lock keeps two writers of one process from setting it under each other.
    """
    spark, mode = rows.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    with _MODE:
        before = spark.conf.get(mode)
        spark.conf.set(mode, "dynamic")
        try:
            rows.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
        finally:
            spark.conf.set(mode, before)

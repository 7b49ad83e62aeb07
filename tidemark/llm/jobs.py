"""Spark pieces that several operators share."""

from __future__ import annotations

import math
import sys
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm import words
from tidemark.session import new_folder, settle


def blocks(df: DataFrame, key: str, text: str, size: int = 8 << 20) -> tuple[DataFrame, int]:
    """Rows in blocks of about ``size`` bytes of text: column ``block`` by hash of the whole row, and their number.

    Equal rows share a block; a key with many rows is spread as far as its texts differ.
    """
    total = df.select(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    n = max(1, math.ceil(total / size))
    return df.withColumn("block", F.pmod(F.xxhash64(key, text), F.lit(n)).cast("int")), n


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: columns are compressed, and unread ones skipped."""
    path = new_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b long); root is the smallest node reachable.

    Labels fall along edges and are then followed to the label's own label, so rounds grow with the
    logarithm of a path's length. Each round is written to the shared folder.
    """
    both = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = settle(both.union(both.select("b", "a")).toDF("node", "peer"))
    label = settle(both.groupBy("node").agg(F.min(F.least("node", "peer")).alias("root")))
    while True:
        seen = both.join(label.toDF("peer", "near"), "peer").groupBy("node").agg(F.min("near").alias("near"))
        low = label.join(seen, "node").select("node", F.least("root", "near").alias("next"), "root")
        hop = low.select(F.col("node").alias("next"), F.col("next").alias("far"))
        # The node's own label and what its label's node has found
        new = low.join(hop, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("root"), F.col("root").alias("old"))
        # A node's old label may improve through any of its members
        pulled = new.groupBy(F.col("old").alias("node")).agg(F.min("root").alias("pull"))
        new = settle(new.join(pulled, "node", "left").select("node", F.least("root", F.coalesce("pull", "root")).alias("root"), "old"))
        label = new.select("node", "root")
        if new.where("root < old").isEmpty():
            return label


def held_out(key: str | Column, folds: int, fold: int) -> Column:
    """True where crc32 of the key as text leaves ``fold`` modulo ``folds``; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def per_process(kind: str, name: str, make):
    """What ``make()`` returned when this worker process first asked for ``name``; later tasks find it again.

    Of each kind only the last one is kept.
    """
    kept = sys.modules.setdefault("tidemark_llm_process", ModuleType("tidemark_llm_process")).__dict__
    if kind not in kept or kept[kind][0] != name:
        kept[kind] = name, make()
    return kept[kind][1]


def annotate(df: DataFrame, text: str, fields: str, make, carry: bool = True, piece: int = words.PIECE) -> DataFrame:
    """``df`` with new columns computed from the bytes of its ``text`` column, which itself stays if ``carry``.

    ``make()`` runs once per task and returns a function from (bytes, row offsets) to one Arrow array per
    field. A column of ``df`` that has the name of a field is replaced. A null text counts as empty.
    """
    added = StructType.fromDDL(fields)
    names = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in names and (carry or f.name != text)]
    at = df.columns.index(text)
    keep = [df.columns.index(f.name) for f in kept]

    def run(batches):
        step = make()
        for batch in batches:
            buf, offsets = words.texts(batch.column(at))
            parts = [step(b, o) for _, _, b, o in words.pieces(buf, offsets, piece)]
            if parts:
                new = [pa.concat_arrays([p[i] for p in parts]) for i in range(len(parts[0]))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in keep] + new, names=[f.name for f in kept] + added.names)

    return df.mapInArrow(run, StructType([*kept, *added]))


#: Counters are summed in this many slices, so no task adds up all of them.
SLICES = 64


def hashed_counts(df: DataFrame, column: str, size: int, count, rough: bool = False) -> np.ndarray:
    """Counts in ``size`` hashed places over all rows, on the driver: 8 ``size`` bytes whatever the input.

    ``count(values)`` yields arrays of the places met in an Arrow column. Tasks add up their own and send what is not
    zero; slices are then summed as they stream by. ``rough``: tasks send one byte per place, to about a sixteenth.
    """
    width = size // SLICES

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at in count(batch.column(0)):
                total += np.bincount(at, minlength=size)
        for i in range(SLICES):
            mine = total[i * width : (i + 1) * width]
            at = np.flatnonzero(mine)
            if len(at) and rough:
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([b""], pa.binary()), pa.array([words.small(mine).tobytes()], pa.binary())], names=["slice", "at", "n"])
            elif len(at):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([mine[at].tobytes()], pa.binary())], names=["slice", "at", "n"])

    def add(batches):
        now, total = None, np.zeros(width, np.int64)
        for batch in batches:
            for i, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and i != now:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "n"])
                    total[:] = 0
                now = i
                if rough:
                    total += np.rint(words.COUNT[np.frombuffer(n, np.uint8)]).astype(np.int64)
                else:
                    total[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "n"])

    parts = df.select(column).mapInArrow(run, "slice int, at binary, n binary")
    summed = parts.repartition(SLICES // 4, "slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, n binary").toArrow()
    out = np.zeros(size, np.int64)
    for i, n in zip(summed["slice"].to_pylist(), summed["n"].to_pylist(), strict=True):
        out[i * width : (i + 1) * width] = np.frombuffer(n, np.int64)
    return out

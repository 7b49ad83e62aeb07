"""Yearly extracts of orders arriving as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import tables as K
from tidemark.session import new_folder
from tidemark.sources import extracts as X
from tidemark.streaming import landing as G
from workload.base import IDS, query
from workload.history import FOLD_SQL, empty_history, shown, yearly_snapshots
from workload.stage import LOAD_SQL, ROW, load, yearly


@query("stream_land", f"select {ROW}, {LOAD_SQL} as _load_id from orders")
def stream_land(spark, sf):
    rows, root = yearly(spark, sf), new_folder(spark, "arrivals")
    name, checkpoint = K.work_table(spark, "landed"), new_folder(spark, "progress")
    first = lambda y: rows.where(F.col("_load_id") == load(y)).drop("_load_id")
    for year in range(1995, 1999):
        X.write_extract(first(year), G.load_folder(root, load(year)))
    G.stream_land(spark, root, checkpoint, name, rows.schema).awaitTermination()
    for year in range(1999, 2002):  # the stream goes on where it stopped
        X.write_extract(first(year), G.load_folder(root, load(year)))
    G.stream_land(spark, root, checkpoint, name, rows.schema).awaitTermination()
    return spark.table(name)


@query("stream_scd2", FOLD_SQL)
def stream_scd2(spark, sf):
    root, checkpoint = new_folder(spark, "arrivals"), new_folder(spark, "progress")
    name = K.work_table(spark, "history")
    K.create_history(spark, name, empty_history(spark).schema)
    snapshots = yearly_snapshots(spark, sf)
    for ts, image in snapshots:
        X.write_extract(image, G.load_folder(root, load(int(ts[:4]))))
    G.stream_scd2(spark, root, checkpoint, name, snapshots[0][1].schema, IDS).awaitTermination()
    return shown(spark.table(name))


@query("stream_late_load", FOLD_SQL)
def stream_late_load(spark, sf):
    """Years out of order, one of them in two pieces and one with wrong content first: the history is as if they came in order."""
    root, checkpoint = new_folder(spark, "arrivals"), new_folder(spark, "progress")
    name = K.work_table(spark, "history")
    K.create_history(spark, name, empty_history(spark).schema)
    images = {int(ts[:4]): image for ts, image in yearly_snapshots(spark, sf)}
    schema = images[1995].schema

    def arrive(*years, part=None, mode="error"):
        for y in years:
            image = images[y] if part is None else images[y].where(F.col("cust_id") % 2 == part)
            X.write_extract(image, G.load_folder(root, load(y)), mode=mode)
        G.stream_scd2(spark, root, checkpoint, name, schema, IDS, late="insert").awaitTermination()

    images[1999], right = images[1999].withColumn("status", F.lit("?")), images[1999]
    arrive(1997, 1999)
    arrive(2001)
    arrive(1996, part=0)
    images[1999] = right
    X.write_extract(right, G.load_folder(root, load(1999)), mode="overwrite")  # files replaced by others
    arrive(2000, 1995)
    arrive(1996, part=1, mode="append")
    arrive(1998)
    return shown(spark.table(name))

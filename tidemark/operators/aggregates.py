"""Aggregations; all of them combine on the map side before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import GROUP_ROWS, By, fits_one_task, slice_by_range


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of the newest row of each key."""
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(newest).select(*keys, "row.*")


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each group in an order.

    The limit on the rank is applied before the shuffle too, so a hot key sends one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, name: str = "rank") -> DataFrame:
    """Rows ranked ``n`` or better in their group, ties included, with the rank; limited before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.rank().over(w)).where(F.col(name) <= n).withColumn(name, F.col(name).cast("bigint"))


def group_having_count(df: DataFrame, keys: Sequence[str], more_than: int = 1) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def max_by_group(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """NULL keys form their own group, as a null-safe comparison would."""
    return df.groupBy(*keys).agg(F.max(column).alias(name))


def connective(kind: Column, value: Column) -> Column:
    """and / or / not over the children of a group; the group's kind is constant.

    The kind is carried as two flags: text in an aggregation buffer would force a sort.
    """
    every, some = F.every(value), F.some(value)
    return F.when(F.some(kind == "or"), some).when(F.some(kind == "not"), ~every).otherwise(every)


def _joined(order: Sequence[str], value: str, sep: str) -> Column:
    entry = F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).cast("string").alias("__v")))
    listed = F.array_sort(F.collect_list(entry))
    return F.when(F.size(listed) > 0, F.array_join(F.transform(listed, lambda e: e["__v"]), sep))


def ordered_string_agg(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    sep: str = ",",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Values of a group joined in order, NULL order keys first.

    Large groups are joined slice by slice first, so that only one piece per slice,
    not every row, meets in the final step.
    """
    if fits_one_task(df, keys, group_rows):
        return df.groupBy(*keys).agg(_joined(order, value, sep).alias(name))
    sliced = slice_by_range(df, keys, [By(o, nulls_first=True) for o in order])
    pieces = sliced.groupBy("__slice", *keys).agg(_joined(order, value, sep).alias("__piece"))
    return pieces.groupBy(*keys).agg(_joined(["__slice"], "__piece", sep).alias(name))

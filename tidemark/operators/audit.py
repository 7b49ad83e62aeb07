"""Checks of keys, references, row rules and list lengths; each returns the violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.predicates import all_of


def audit_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; counted on the map side first."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def audit_orphans(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Child rows whose reference has no parent; a NULL reference is allowed."""
    given = child.where(all_of(F.col(c).isNotNull() for c in on))
    return given.join(parent, all_of(given[c] == parent[p] for c, p in on.items()), "left_anti")


def audit_check(df: DataFrame, check: Column) -> DataFrame:
    """Rows for which the rule is false; an unknown result passes, as in SQL."""
    return df.where(~check)


def audit_arity(df: DataFrame, names: str, values: str) -> DataFrame:
    """Rows whose two lists differ in length."""
    return df.where(F.coalesce(F.size(names), F.lit(0)) != F.coalesce(F.size(values), F.lit(0)))

"""Column lists, run constants and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.predicates import OPEN_END, ntz


def project_columns(df: DataFrame, columns: Sequence[str] | None = None, leave_out: Sequence[str] = ()) -> DataFrame:
    """An explicit column list, or all columns but the technical ones."""
    return df.select(*columns) if columns is not None else df.drop(*leave_out)


def add_run_constants(df: DataFrame, ts: str, max_ts: str = OPEN_END, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    return df.withColumns({start: ntz(ts), end: ntz(max_ts)})


def label_indented(path: str | Column, name: str | Column, identifier: str | Column) -> Column:
    """Name and identifier, indented two blanks per level of the path."""
    path = F.col(path) if isinstance(path, str) else path
    name = F.col(name) if isinstance(name, str) else name
    words = F.coalesce(F.concat(F.lit(" "), F.array_join(identifier, " ")), F.lit(""))
    return F.concat(F.repeat(F.lit(" "), 2 * F.size(path)), name, words)

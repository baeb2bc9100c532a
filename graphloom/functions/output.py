"""Compact text of query results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): the values of the columns joined by ` | `, NULL as empty text."""
    values: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(F.concat_ws(" | ", *values).alias("line"))


def compact(df: DataFrame, header: str, columns: list[str], limit: int | None = None) -> str:
    """`HEADER (n):` with the number of all rows and their lines, or `HEADER: No results found.`

    The text is made for a reader, on the driver. limit: the caller's bound on the lines; the number stays that of all rows.
    """
    rows = compact_rows(df, columns)
    lines = [r.line for r in (rows if limit is None else rows.limit(limit)).collect()]
    n = len(lines) if limit is None or len(lines) < limit else df.count()
    return "\n".join([f"{header} ({n}):", *lines]) if n else f"{header}: No results found."

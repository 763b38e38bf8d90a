"""Exporting query results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "error") -> str:
    """Write a result as CSV with a header and return the folder.

    A folder of part files by default, one per task; `single_file` gathers all rows in one task, for results
    known to be small. An empty result is refused and writes nothing.
    """
    if df.isEmpty():
        raise ValueError("query returned 0 rows, nothing to export")
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path

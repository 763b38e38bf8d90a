"""Filters, projections and picks. All are applied before any Python stage, so they reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import ellipsis, single_line
from ..sources.row_ids import RID
from .enrich import check_columns


def subset(df: DataFrame, where: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that satisfy an SQL predicate, and the named columns. `_rid` is always kept."""
    out = df.where(F.expr(where)) if where else df
    if not columns:
        return out
    check_columns(df, columns)
    wanted = list(dict.fromkeys(([RID] if RID in df.columns else []) + list(columns)))
    return out.select(*[F.col(f"`{c}`") for c in wanted])


def drill_down(df: DataFrame, where: str | None = None, parent_column: str | None = None, parent_value=None) -> DataFrame:
    """`where` and, if both are given, `parent_column = parent_value`. The value is a literal, never spliced."""
    if parent_value is not None and not parent_column:
        raise ValueError("parent_column is required when parent_value is given")
    out = df.where(F.expr(where)) if where else df
    if parent_column:
        check_columns(df, [parent_column])
        if parent_value is not None:
            out = out.where(F.col(f"`{parent_column}`") == F.lit(parent_value))
    return out


def pick_rows(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose `_rid` occurs in `ids`."""
    return df.join(ids.select(RID), RID, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])


def preview(df: DataFrame, limit: int = fixed.PREVIEW_ROWS, cell: int = fixed.PREVIEW_CELL_CHARS) -> DataFrame:
    """The first `limit` rows as text, nulls as 'NULL', long cells cut."""
    shown = [ellipsis(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")), cell).alias(c) for c in df.columns]
    return df.limit(limit).select(*shown)


def is_truncated(df: DataFrame, limit: int = fixed.PREVIEW_ROWS) -> bool:
    """Whether a preview of `limit` rows leaves rows out: looks for one row more, does not count the result."""
    return not df.offset(limit).isEmpty()


def flat_text(column: str, limit: int = 100):
    """A text cell on one line, cut."""
    return ellipsis(single_line(F.col(column)), limit)

"""Derived columns in tables of their own, beside the table they belong to.

The base table is written once in buckets of `_rid`. Each new column, or set of columns made together, is a narrow table
`(_rid, columns)` in buckets alike, so adding one writes that one alone, and a read that wants all of them joins bucket by bucket
without an exchange. The newest of several columns of one name is the one that is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..buckets import open_buckets, write_buckets
from ..scratch import new_path
from ..sources.row_ids import RID
from .skew import fan_out


class SideTables:
    """`frame()` is the table with all its columns, in the order in which they came."""

    def __init__(self, base: DataFrame, buckets: int | None = None, name: str = "table"):
        self.name, self.buckets = name, buckets or fan_out(base.sparkSession)
        self.base, self.columns = self._written(base, name), list(base.columns)
        self.sides: list[tuple[DataFrame, list[str]]] = []
        self.owner: dict[str, int] = dict.fromkeys(base.columns, -1)

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(df.sparkSession, name)
        write_buckets(df, path, RID, self.buckets)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return open_buckets(df.sparkSession, path, schema, RID, self.buckets)

    def add(self, df: DataFrame, columns: Sequence[str]) -> None:
        """Write `columns` of `df`, which has a row for each `_rid`; rows that it lacks have null."""
        side = self._written(df.select(RID, *[F.col(f"`{c}`") for c in columns]), f"{self.name}-side")
        self.sides.append((side, list(columns)))
        for c in columns:
            self.owner[c] = len(self.sides) - 1
            self.columns = [x for x in self.columns if x != c] + [c]

    def drop(self, columns: Sequence[str]) -> None:
        for c in columns:
            self.owner.pop(c, None)
        self.columns = [c for c in self.columns if c not in columns]

    def frame(self, columns: Sequence[str] | None = None) -> DataFrame:
        """All columns, or some: only the tables that hold these are read."""
        wanted = list(columns) if columns is not None else self.columns
        own = [c for c in wanted if c != RID and self.owner[c] == -1]
        out = self.base.select(RID, *[F.col(f"`{c}`") for c in own])
        for k, (side, _) in enumerate(self.sides):
            held = [c for c in wanted if self.owner[c] == k]
            if held:  # both sides are dealt by the key already, so a merge join moves nothing
                out = out.join(side.select(RID, *[F.col(f"`{c}`") for c in held]).hint("merge"), RID, "left")
        return out.select(*[F.col(f"`{c}`") for c in wanted])

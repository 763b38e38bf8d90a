"""Small helpers for expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with `value` computed once. Inside a lambda an expression over columns is computed anew for every
    element; a lambda's variable is not."""
    return F.get(F.transform(F.array(value), then), F.lit(0))

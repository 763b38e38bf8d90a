"""Counting labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _label(column: str):
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("NULL"))


def label_distribution(df: DataFrame, column: str) -> DataFrame:
    """`(label, n)`, nulls as 'NULL', largest first."""
    return df.groupBy(_label(column).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def parent_child_distribution(df: DataFrame, parent: str, child: str) -> DataFrame:
    """`(parent, child, n, level)`: counts per pair (level 0), per parent (1) and in all (2).

    Pairs are counted first, so the subtotals are rolled up over the few distinct pairs and not the rows.
    """
    pairs = df.groupBy(_label(parent).alias("parent"), _label(child).alias("child")).agg(F.count(F.lit(1)).alias("__n"))
    return pairs.rollup("parent", "child").agg(
        F.sum("__n").alias("n"), (F.grouping("parent") + F.grouping("child")).cast("int").alias("level")
    ).select("parent", "child", "n", "level")


def topic_shares(df: DataFrame, column: str) -> DataFrame:
    """`(label, n, pct)` without nulls; percent of the labelled rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    # the window is over one row per topic
    share = F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4)
    return counts.select("label", "n", share.alias("pct"))

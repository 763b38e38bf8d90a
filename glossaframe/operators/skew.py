"""Joins and per-group limits that hold when one key carries a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A key with more than 1/HOT_SHARE of all rows is hot, so there are never more than HOT_SHARE hot keys:
# the list of them is small enough to broadcast whatever the size of the table.
HOT_SHARE = 1024


def fan_out(spark: SparkSession) -> int:
    """How many pieces a hot group is split into: as many as a shuffle has partitions."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(df: DataFrame, pieces: int | None = None) -> DataFrame:
    """Deal the rows over `pieces` partitions (as many as a shuffle has) before costly work per row, whatever the
    size of the table and the way its files are split."""
    return df.repartition(pieces or fan_out(df.sparkSession))


def is_hot(n: int, total: int) -> bool:
    return n > max(1, total // HOT_SHARE)


def hot_keys(counts: DataFrame, key: str, n: str = "n_rows", total: int | None = None,
             largest: int | None = None) -> DataFrame | None:
    """Keys of a `(key, n)` table that hold more than 1/HOT_SHARE of the rows, or None if there are none.

    `total` and `largest` save a pass over the counts where they are known.
    """
    if total is None or largest is None:
        sizes = counts.agg(F.sum(n).alias("total"), F.max(n).alias("largest")).first()
        total, largest = sizes["total"] or 0, sizes["largest"] or 0
    if not is_hot(largest, total):
        return None
    return counts.where(F.col(n) > F.lit(max(1, total // HOT_SHARE))).select(key)


def join_skewed(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, spread: Column,
                how: str = "left") -> DataFrame:
    """Equi-join a large `left` with a `right` that has one row per key.

    Rows of hot keys are dealt over `fan_out` salts by `spread`, and only the few hot rows of `right` are
    repeated per salt. `hot=None` means no key is hot.
    """
    if hot is None:
        return left.join(right, key, how)
    pieces = fan_out(left.sparkSession)
    flags = F.broadcast(hot.select(key, F.lit(True).alias("__hot")))
    salted_left = left.join(flags, key, "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(pieces)).cast("int")).otherwise(F.lit(0))
    ).drop("__hot")
    all_salts = F.sequence(F.lit(0), F.lit(pieces - 1))
    salted_right = right.join(flags, key, "left").withColumn(
        "__salt", F.explode(F.when(F.col("__hot"), all_salts).otherwise(F.array(F.lit(0))))
    ).drop("__hot")
    return salted_left.join(salted_right, [key, "__salt"], how).drop("__salt")


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, spread: Column,
                    rank: str = "rank") -> DataFrame:
    """The first `n` rows of every group, exactly, without sorting a whole group in one task.

    Each group is first cut to `n` rows inside each of `fan_out` pieces (and, for small `n`, before the shuffle:
    Spark pushes the limit below the exchange), so the final sort sees at most `n * fan_out` rows of a group.
    """
    pieces = fan_out(df.sparkSession)
    within = Window.partitionBy(*group, "__salt").orderBy(*order)
    across = Window.partitionBy(*group).orderBy(*order)
    cut = (
        df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(pieces)))
        .withColumn("__piece_rank", F.row_number().over(within))
        .where(F.col("__piece_rank") <= n)
        .drop("__salt", "__piece_rank")
    )
    return cut.withColumn(rank, F.row_number().over(across)).where(F.col(rank) <= n)

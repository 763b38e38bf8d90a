"""Connected components of a graph given as a table of links, without gathering any neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stage
from .files import discard

MOST_ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): each node that has a link to another node, with the smallest node it can reach.

    Every round replaces links by links to smaller nodes: first each link's lower end by that end's smallest
    neighbour, then each node's neighbours by links to the smallest of them. Rounds grow with the logarithm of the
    longest path. Only minima per node are aggregated (combined before the shuffle) and joined back, so a hub with a
    third of all links is one row of an aggregate, and its links are an ordinary skewed join side.
    Null ends and loops are left out; a table without links gives an empty result.
    """
    pairs = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(
        F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    now = stage(pairs.distinct(), "links")
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        lowest = now.groupBy("u").agg(F.min("v").alias("m"))
        jumped = (now.join(lowest.select(F.col("u").alias("v"), "m"), "v", "left")
                  .select("u", F.coalesce("m", "v").alias("v")).distinct())
        least = jumped.groupBy("u").agg(F.min("v").alias("m"))
        lifted = jumped.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, stage(lifted.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(last)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

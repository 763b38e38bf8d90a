"""Frequent word runs, level by level.

A run of n words can only be in `min_rows` rows if both its runs of n - 1 words are. So each level looks only at places
where two frequent runs overlap, and nothing else is listed, hashed or shuffled. A row keeps the places of its frequent
runs as one array `(pos, h)`, with a 64-bit hash of the run; the runs themselves are spelled out once per
distinct frequent run, from those of the level below.

The most frequent runs need no listing of all that reach `min_rows`: `top_runs` raises that bar until few words reach it.
Few frequent runs are looked for inside each row, so that places are not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import explode_values, norm_words, text_or_empty
from ..scratch import stage
from ..sources.row_ids import RID


# up to this many frequent runs of a level travel as a list of their hashes
LISTED = 4096


@dataclass
class FrequentRuns:
    """For each length: `levels[n]` has `(h, phrase, support, left, right)`, a row for each frequent run, with the hashes of
    its runs of one word less; `places[n]` has `(_rid, at)`, a row for each row of the table that holds some, `at` being
    their `(pos, h)` in order of place, counted in words from 0."""

    levels: dict[int, DataFrame]
    places: dict[int, DataFrame]

    def supports(self, low: int, closed: bool = False) -> DataFrame:
        """`(phrase, support, words, h)` of the runs of `low` words or more; with `closed`, without those that are part of a
        run one word longer (among those mined) with the same support."""
        parts = [self.levels[min(self.levels)].select("phrase", "support", F.lit(0).alias("words"), "h").limit(0)]
        for n, level in sorted(self.levels.items()):
            if n >= low:
                if closed and n + 1 in self.levels:
                    longer = self.levels[n + 1].select(F.explode(F.array("left", "right")).alias("h"), "support").distinct()
                    level = level.join(longer, ["h", "support"], "left_anti")
                parts.append(level.select("phrase", "support", F.lit(n).alias("words"), "h"))
        return reduce(DataFrame.unionByName, parts)

    def places_of(self, hashes: dict[int, list[int]]) -> DataFrame:
        """`(_rid, pos, h)` of a short list of runs, given by their number of words."""

        def of(n: int, some: list[int]) -> DataFrame:
            return explode_values(self.places[n], [RID], F.filter("at", lambda p: p["h"].isin(some)), "p").select(RID, "p.pos", "p.h")

        return reduce(DataFrame.unionByName, [of(n, some) for n, some in hashes.items()])


def _neighbours(array: Column) -> tuple[Column, Column]:
    """An array without its last element, and without its first."""
    n = F.greatest(F.size(array) - 1, F.lit(0))
    return F.slice(array, F.lit(1), n), F.slice(array, F.lit(2), n)


def _overlapping(at: Column) -> Column:
    """`(pos, h, left, right)` where a run stands one word before another one."""
    first, second = _neighbours(at)
    pairs = F.zip_with(first, second, lambda a, b: F.when(a["pos"] + 1 == b["pos"], F.struct(
        a["pos"].alias("pos"), F.xxhash64(a["h"], b["h"]).alias("h"), a["h"].alias("left"), b["h"].alias("right"))))
    return F.filter(pairs, lambda p: p.isNotNull())


def _distinct(at: Column) -> Column:
    """`(h, left, right)` once for each run. Sorted first: comparing all pairs of structs is what `array_distinct` would do."""
    ordered = F.array_sort(F.transform(at, lambda p: F.struct(p["h"].alias("h"), p["left"].alias("left"), p["right"].alias("right"))))
    fresh = F.transform(F.array(ordered), lambda every: F.filter(every, lambda p, i: (i == 0) | (F.get(every, i - 1)["h"] != p["h"])))
    return F.get(fresh, F.lit(0))


def _kept(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """The places of frequent runs, by row. A few runs are picked out inside the rows; otherwise places are shuffled, of which a
    row has no more than words."""
    few = frequent.select("h").limit(LISTED + 1).collect()
    if len(few) <= LISTED:
        listed = [r["h"] for r in few]
        return candidates.select(RID, F.transform(F.filter("at", lambda p: p["h"].isin(listed)), lambda p: F.struct(p["pos"].alias("pos"), p["h"].alias("h"))).alias("at"))
    places = explode_values(candidates, [RID], F.transform("at", lambda p: F.struct(p["pos"].alias("pos"), p["h"].alias("h"))), "p").select(RID, "p.pos", "p.h")
    kept = places.join(frequent.select("h"), "h", "left_semi")
    return kept.groupBy(RID).agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("at"))


def frequent_runs(df: DataFrame, text_column: str, low: int, high: int, min_rows: int) -> FrequentRuns:
    """The runs of `low`..`high` words (compared as `norm_words` has them) that occur in `min_rows` rows or more."""
    words = norm_words(text_or_empty(F.col(f"`{text_column}`")))
    shortest = max(1, low)
    runs = df.select(RID, words.alias("words"))
    if shortest > 1:
        starts = F.sequence(F.lit(1), F.size("words") - shortest + 1)
        spelled = F.when(F.size("words") >= shortest, F.transform(starts, lambda i: F.concat_ws(" ", F.slice("words", i, F.lit(shortest)))))
        runs = runs.select(RID, F.coalesce(spelled, F.array().cast("array<string>")).alias("words"))
    runs = stage(runs, "runs")
    counted = row_counts(runs, min_rows)
    return _mined(runs, counted, shortest, high, min_rows)


def row_counts(runs: DataFrame, min_rows: int) -> DataFrame:
    """`(phrase, support)` of the elements of `words` that are in `min_rows` rows or more."""
    one = explode_values(runs, [], F.array_distinct("words"), "phrase")
    return one.groupBy("phrase").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_rows)


def _mined(runs: DataFrame, counted: DataFrame, shortest: int, high: int, min_rows: int, prune: bool = True) -> FrequentRuns:
    """Level by level from the counted elements of `words`, each a run of `shortest` words. Without `prune` a level looks at all
    runs of frequent elements, and not only where both runs of the level below are frequent; the levels are the same."""
    none = F.lit(None).cast("bigint")
    levels = {shortest: stage(counted.select(F.xxhash64("phrase").alias("h"), "phrase", "support", none.alias("left"), none.alias("right")), "frequent-runs")}
    first = runs.select(RID, F.transform("words", lambda w, i: F.struct(i.alias("pos"), F.xxhash64(w).alias("h"))).alias("at"))
    places = {shortest: stage(_kept(first, levels[shortest]), "run-places").where(F.size("at") > 0)}
    for n in range(shortest + 1, high + 1):
        below = levels[n - 1]
        candidates = places[n - 1].select(RID, _overlapping(F.col("at")).alias("at"))
        found = explode_values(candidates, [], _distinct(F.col("at")), "p").groupBy("p.h").agg(
            F.count(F.lit(1)).alias("support"), F.first("p.left").alias("left"), F.first("p.right").alias("right")).where(F.col("support") >= min_rows)
        begins = below.select(F.col("h").alias("left"), F.col("phrase").alias("begin"))
        ends = below.select(F.col("h").alias("right"), F.substring_index("phrase", " ", -1).alias("end"))
        spelled = found.join(begins, "left").join(ends, "right").select("h", F.concat_ws(" ", "begin", "end").alias("phrase"), "support", "left", "right")
        levels[n] = stage(spelled, "frequent-runs")
        if levels[n].isEmpty():
            break
        every = candidates.select(RID, F.transform("at", lambda p: F.struct(p["pos"].alias("pos"), p["h"].alias("h"))).alias("at"))
        places[n] = stage(_kept(candidates, levels[n]) if prune else every, "run-places").where(F.size("at") > 0)
    return FrequentRuns({n: level for n, level in levels.items() if n == shortest or n in places}, places)


def top_runs(df: DataFrame, text_column: str, low: int, high: int, min_rows: int, most_rows: int, k: int, closed: bool = False,
             prune: bool = True) -> tuple[FrequentRuns, DataFrame]:
    """Runs among which are the `k` most frequent ones of `low`..`high` words that occur in `min_rows`..`most_rows` rows, all
    there are if they are fewer; and their `supports`, written.

    No run is in more rows than its rarest word. So all runs of at least some support are made of words of at least this support, and if there are
    `k` of them, the top `k` are among them. The bar starts at the support of the k-th word and is lowered until there are; each
    try is complete for its bar, also as to longer runs of the same support.
    """
    runs = stage(df.select(RID, norm_words(text_or_empty(F.col(f"`{text_column}`"))).alias("words")), "runs")
    words = stage(row_counts(runs, min_rows), "word-rows")
    head = words.where(F.col("support") <= most_rows).orderBy(F.desc("support")).limit(k).agg(F.min("support")).first()[0]
    bar = max(min_rows, head or 0)
    while True:
        found = _mined(runs, words.where(F.col("support") >= bar), 1, high, bar, prune)
        supports = stage(found.supports(low, closed).where(F.col("support") <= most_rows), "top-runs")
        if bar == min_rows or supports.limit(k).count() == k:
            return found, supports
        bar = max(min_rows, bar // 3)

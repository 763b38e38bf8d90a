"""Reproducible samples: random, stratified, and diverse by embedding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stage
from ..sources.row_ids import RID
from .enrich import check_choice, check_columns
from .filters import pick_rows
from .similarity import column_matrix, unit_rows
from .skew import spread, top_n_per_group

# Candidates fetched per pass of the diverse sample.
DIVERSE_CANDIDATES = 512
# Numbers in a block of vectors of which a core-set is made.
CORESET_FLOATS = 4_000_000


def random_order(seed: int, id_column: str = RID) -> Column:
    """A fixed pseudo-random order of the rows."""
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(str(seed))))


def sample_random(df: DataFrame, n: int, seed: int = 0, id_column: str = RID) -> DataFrame:
    """`n` rows, the first in a seeded pseudo-random order; the rows of the result are in no order.

    A first pass over the ids counts rows per hash prefix; all rows below the cut-off prefix
    are taken where they lie, and only the rows of that one prefix are ordered.
    """
    if n <= 0:
        raise ValueError("sample size must be positive")
    order = random_order(seed, id_column)
    bucket = F.conv(F.substring(order, 1, 4), 16, 10).cast("int")
    counts = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()  # at most 65536 rows
    taken, cut, rest = 0, None, 0
    for row in counts:
        if taken + row["n"] >= n:
            cut, rest = row["b"], n - taken
            break
        taken += row["n"]
    if cut is None:
        return df
    below = df.where(bucket < F.lit(cut))
    edge = df.where(bucket == F.lit(cut)).orderBy(order, id_column).limit(rest)
    return below.unionByName(edge)


def sample_stratified(df: DataFrame, stratify_by: str, n: int, mode: str = "quota", seed: int = 0,
                      id_column: str = RID) -> DataFrame:
    """`quota`: up to `n` random rows of each stratum. `ordered`: the first `n` rows by stratum, then random
    order, which may never reach the later strata."""
    check_columns(df, [stratify_by])
    check_choice("mode", mode, ["quota", "ordered"])
    if n <= 0:
        raise ValueError("sample size must be positive")
    if mode == "ordered":
        return df.orderBy(F.asc_nulls_last(stratify_by), random_order(seed, id_column), id_column).limit(n)
    # only ids and strata are shuffled; the picked ids are then looked up in the table
    narrow = df.select(F.col(id_column), F.col(stratify_by).alias("__stratum"), random_order(seed, id_column).alias("__order"))
    picked = top_n_per_group(narrow, ["__stratum"], [F.col("__order"), F.col(id_column)], n, F.col(id_column))
    return df.join(picked.select(id_column), id_column, "left_semi").select(*df.columns)


def sample_diverse(df: DataFrame, n: int, vector: str, id_column: str = RID) -> DataFrame:
    """`(id, pick)`: greedy farthest-point picks by cosine distance, exact, starting from the lowest id.

    One pass over the vectors returns the rows least similar to what is picked so far, and the similarity
    that every other row exceeds. Similarity to the picked set only grows, so the driver can go on picking
    from these candidates for as long as the best one stays within that bound: usually many picks per pass.
    """
    if n <= 0:
        raise ValueError("sample size must be positive")
    spark = df.sparkSession
    # null vectors count as zero vectors, which resemble nothing
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).alias("v"))
    result = "id bigint, pick int"
    start = rows.agg(F.min_by("v", "id").alias("v"), F.min("id").alias("id"), F.max(F.size("v")).alias("dim")).first()
    if start["id"] is None:
        return spark.createDataFrame([], result).withColumnRenamed("id", id_column)
    dim = max(1, start["dim"] or 1)
    first = np.asarray(start["v"], dtype="float64")[None, :] if start["v"] else np.zeros((1, dim))
    chosen, ids = unit_rows(first), [start["id"]]
    while len(ids) < n:
        candidates = _least_similar(rows, chosen, np.array(ids), dim)
        if candidates.num_rows == 0:
            break
        cid = np.asarray(candidates.column("id"))
        vectors = unit_rows(column_matrix(candidates.column("v"), dim))
        worst = (candidates.column("sim")[-1].as_py(), int(cid[-1]))
        complete = candidates.num_rows < DIVERSE_CANDIDATES
        similarity = np.asarray(candidates.column("sim"), dtype="float64").copy()
        free = np.ones(len(cid), dtype=bool)
        while len(ids) < n and free.any():
            at = min(np.flatnonzero(free), key=lambda i: (similarity[i], cid[i]))
            if not complete and (similarity[at], cid[at]) > worst:
                break
            free[at] = False
            ids.append(int(cid[at]))
            chosen = np.vstack([chosen, vectors[at]])
            similarity = np.maximum(similarity, np.round(vectors @ vectors[at], 12))
    return spark.createDataFrame([(i, p + 1) for p, i in enumerate(ids)], result).withColumnRenamed("id", id_column)


def _least_similar(rows: DataFrame, chosen: np.ndarray, ids: np.ndarray, dim: int) -> pa.Table:
    """The rows not picked yet with the smallest greatest similarity to the picked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~np.isin(np.asarray(batch.column(0)), ids)))
            if batch.num_rows == 0:
                continue
            similarity = np.round((unit_rows(column_matrix(batch.column(1), dim)) @ chosen.T).max(axis=1), 12)
            best = np.lexsort((np.asarray(batch.column(0)), similarity))[:DIVERSE_CANDIDATES]
            kept = batch.take(pa.array(best))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(similarity[best])], names=["id", "v", "sim"])

    schema = f"id bigint, v {rows.schema['v'].dataType.simpleString()}, sim double"
    return rows.mapInArrow(run, schema).orderBy("sim", "id").limit(DIVERSE_CANDIDATES).toArrow()


def sample_diverse_coreset(df: DataFrame, n: int, vector: str, id_column: str = RID) -> DataFrame:
    """`(id, pick)`: farthest-point picks from core-sets, in a number of passes that does not depend on `n`.

    Each task goes over its vectors in blocks of bounded size and keeps the greedy picks of every block; these are
    gathered and thinned in the same way until one block holds them, whose picks are the sample. In terms of the angle's
    chord, each level adds at most twice the best possible radius for `n` picks, so with l levels every vector lies within
    2 * l times that radius of a pick (`sample_diverse` gives 2). Which rows are picked depends on how the table is split.
    A block holds at least 4 * n vectors. Null and zero vectors resemble nothing and count as one place; rows without
    an id are left out.
    """
    if n <= 0:
        raise ValueError("sample size must be positive")
    spark = df.sparkSession
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull())
    head = rows.select(F.size("v").alias("d")).where("d > 0").first()
    dim = head["d"] if head else 1
    block = max(4 * n, CORESET_FLOATS // dim)

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            # a batch may be larger than what a block has left
            for low in range(0, batch.num_rows, block):
                part = batch.slice(low, block)
                if size + part.num_rows > block:
                    yield _farthest(held, n, dim)
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            yield _farthest(held, n, dim)

    schema = f"id bigint, v {rows.schema['v'].dataType.simpleString()}, pick int"
    core = stage(rows.mapInArrow(thinned, schema), "coreset")
    while (size := core.count()) > block:
        parts = -(-size // block)
        core = stage(core.select("id", "v").repartition(parts).mapInArrow(thinned, schema), "coreset")
    picked = core.select("id", "v").coalesce(1).mapInArrow(thinned, schema)
    return stage(picked.select(F.col("id").alias(id_column), "pick"), "coreset-picks")


def _farthest(batches: list[pa.RecordBatch], n: int, dim: int) -> pa.RecordBatch:
    """The first `n` greedy picks of these `(id, v)` rows, from the lowest id, with their number from 1."""
    table = pa.Table.from_batches([b.select(["id", "v"]) for b in batches]).sort_by("id").combine_chunks()
    unit = unit_rows(column_matrix(table.column("v"), dim))
    similarity = np.full(len(unit), -np.inf)
    free = np.ones(len(unit), dtype=bool)
    picks = []
    while len(picks) < min(n, len(unit)):
        at = int(np.argmin(np.where(free, similarity, np.inf)))  # ties: the lowest id
        picks.append(at)
        free[at] = False
        similarity = np.maximum(similarity, np.round(unit @ unit[at], 12))
    kept = table.take(pa.array(picks, pa.int64())).combine_chunks()
    numbers = pa.array(range(1, len(picks) + 1), pa.int32())
    return pa.RecordBatch.from_arrays([kept.column(0).chunk(0), kept.column(1).chunk(0), numbers], ["id", "v", "pick"])


def sample_rows(df: DataFrame, sample_size: int, where: str | None = None, method: str = "random",
                stratify_by: str | None = None, text_column: str | None = None, encoder=None,
                vector_column: str | None = None, seed: int = 0, stratified_mode: str = "quota") -> DataFrame:
    """A sample of whole rows. `diverse` reads a vector column, or encodes a text column; `diverse_coreset` does so in
    few passes, for large samples of large tables."""
    check_choice("method", method, ["random", "stratified", "diverse", "diverse_coreset"])
    scope = df.where(F.expr(where)) if where else df
    if method == "random":
        return sample_random(scope, sample_size, seed)
    if method == "stratified":
        if not stratify_by:
            raise ValueError("stratify_by is required when method='stratified'")
        return sample_stratified(scope, stratify_by, sample_size, stratified_mode, seed)
    pick = sample_diverse if method == "diverse" else sample_diverse_coreset
    if vector_column is None:
        if not text_column or encoder is None:
            raise ValueError("method='diverse' needs a vector column, or a text column and an encoder")
        check_columns(df, [text_column])
        texts = spread(scope.select(RID, text_column))
        # written, because every pass of the greedy choice reads the vectors again
        vectors = stage(encoder.encode(texts, text_column, "__vector").select(RID, "__vector"), "vectors")
        return pick_rows(scope, pick(vectors, sample_size, "__vector"))
    return pick_rows(scope, pick(scope, sample_size, vector_column))

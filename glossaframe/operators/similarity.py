"""Rows against a set of vectors: routing to prototypes, nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stage
from .skew import top_n_per_group

# One block of vectors travels with the task closure and is multiplied with each Arrow batch. Larger sets
# are worked off block by block, so the size of a block is the only thing held in memory.
BLOCK_FLOATS = 4_000_000
# Similarities are computed for this many pairs at a time.
PAIRS_AT_ONCE = 4_000_000
# Similarities are rounded before they are ranked, so that equal rows are ordered by id.
ROUND_SIMILARITY = 9
# More than rounding can move a similarity.
ROUNDED_AWAY = 1e-8


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; rows without length stay zero, so their cosine with anything is 0."""
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def column_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as a float64 matrix. A null vector counts as a zero vector; any other length is an error."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0))
    out = np.zeros((len(column), dim))
    filled = sizes > 0
    if not np.all(sizes[filled] == dim):
        raise ValueError(f"vectors must have {dim} entries")
    out[filled] = np.asarray(column.flatten().fill_null(0.0), dtype="float64").reshape(-1, dim)
    return out


def _blocks(vectors: DataFrame, index: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors in ascending `index`, as bounded `(indexes, unit rows)` blocks."""
    head = vectors.select(F.size(vector).alias("d")).where("d > 0").first()
    if head is None:
        return
    dim = head["d"]
    rows_per_block = max(1, BLOCK_FLOATS // dim)
    low = None
    while True:
        rest = vectors if low is None else vectors.where(F.col(index) > F.lit(low))
        part = rest.select(index, vector).orderBy(index).limit(rows_per_block + 1).toArrow()
        if part.num_rows == 0:
            return
        indexes = np.asarray(part.column(0), dtype="int64")
        size = len(indexes)
        if size > rows_per_block:  # rows of one index stay together
            size = int(np.searchsorted(indexes, indexes[-1]))
            if size == 0:
                raise ValueError(f"{index} {indexes[-1]} has more than {rows_per_block} rows")
        yield indexes[:size], unit_rows(column_matrix(part.column(1).slice(0, size), dim))
        if part.num_rows <= rows_per_block:
            return
        low = int(indexes[size - 1])


def best_prototype(df: DataFrame, vector: str, prototypes: DataFrame, index: str = "idx",
                   prototype_vector: str = "vector") -> DataFrame:
    """Add `best_idx` and `best_similarity`: the most similar prototype by cosine, ties to the lowest index."""
    scored = df.withColumn("best_idx", F.lit(None).cast("bigint")).withColumn("best_similarity", F.lit(None).cast("double"))
    at = scored.columns.index(vector)
    for number, (indexes, block) in enumerate(_blocks(prototypes, index, prototype_vector)):

        def run(batches, indexes=indexes, block=block):
            for batch in batches:
                rows = unit_rows(column_matrix(batch.column(at), block.shape[1]))
                pick = np.empty(len(rows), dtype="int64")
                best = np.empty(len(rows))
                for part in _slices(len(rows), len(block)):
                    sims = rows[part] @ block.T
                    pick[part] = sims.argmax(axis=1)
                    best[part] = sims.max(axis=1)
                chosen = indexes[pick]
                known = np.asarray(batch.column(batch.num_columns - 1).fill_null(-2.0), dtype="float64")
                kept = np.asarray(batch.column(batch.num_columns - 2).fill_null(-1), dtype="int64")
                better = best > known
                columns = batch.columns[:-2] + [
                    pa.array(np.where(better, chosen, kept), pa.int64()),
                    pa.array(np.where(better, best, known), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        if number:
            scored = stage(scored, "prototype-block")
        scored = scored.mapInArrow(run, scored.schema)
    return scored


def _slices(rows: int, others: int) -> Iterator[slice]:
    step = max(1, PAIRS_AT_ONCE // max(1, others))
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))


def _keep_best(best, query_ids, ids, sims, k):
    """Merge a block of similarities into the running `(query, id, similarity)` columns, `k` per query."""
    if sims.shape[1] > k:  # all rows at least as similar as the k-th, ties included
        kth = -np.partition(-sims, k - 1, axis=1)[:, k - 1]
        near = (sims >= kth[:, None]) & np.isfinite(sims)
    else:
        near = np.isfinite(sims)
    at_query, at_row = np.nonzero(near)
    queries = np.concatenate([best[0], query_ids[at_query]])
    rows = np.concatenate([best[1], ids[at_row]])
    values = np.concatenate([best[2], sims[at_query, at_row]])
    order = np.lexsort((rows, -values, queries))
    queries, rows, values = queries[order], rows[order], values[order]
    first_of_query = np.searchsorted(queries, queries, side="left")
    keep = np.arange(len(queries)) - first_of_query < k
    return queries[keep], rows[keep], values[keep]


def _bars(best, query_ids, k):
    """For each query the similarity below which, unrounded, a row cannot be among its `k` any more."""
    queries, _, values = best
    last = np.flatnonzero(np.arange(len(queries)) - np.searchsorted(queries, queries, side="left") == k - 1)
    bars = np.full(len(query_ids), -np.inf)
    if len(last):
        at = np.minimum(np.searchsorted(queries[last], query_ids), len(last) - 1)
        full = queries[last][at] == query_ids
        bars[full] = values[last][at[full]] - ROUNDED_AWAY
    return bars


def _merged(best, pending, k):
    """The running columns with unrounded candidates of their form, `k` per query."""
    queries, rows, values = (np.concatenate(c) for c in zip(best, *pending))
    values = np.round(values, ROUND_SIMILARITY)
    order = np.lexsort((rows, -values, queries))
    queries, rows, values = queries[order], rows[order], values[order]
    keep = np.arange(len(queries)) - np.searchsorted(queries, queries, side="left") < k
    return queries[keep], rows[keep], values[keep]


def nearest_neighbours(corpus: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id",
                       vector: str = "embedding", query_id: str = "query_id", skip_same_id: bool = True) -> DataFrame:
    """Exact `(query_id, id, similarity, rank)` for the `k` most similar rows to each query.

    Each task keeps `k` candidates per query, so what is shuffled does not grow with the number of pairs. Once a query has `k`, only
    the few rows that reach the similarity of its last one are looked at further. More queries than fit into one block take one pass over the corpus per block.
    """
    passes = []
    schema = f"{query_id} bigint, {id_column} bigint, similarity double"
    for indexes, block in _blocks(queries.select(F.col(id_column).alias(query_id), vector), query_id, vector):

        def run(batches, indexes=indexes, block=block):
            best, bars = (np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)), None
            pending, n_pending = [], 0
            for batch in batches:
                all_ids = np.asarray(batch.column(0), dtype="int64")
                rows = unit_rows(column_matrix(batch.column(1), block.shape[1]))
                for part in _slices(len(rows), len(block)):
                    ids = all_ids[part]
                    sims = block @ rows[part].T
                    if bars is None:
                        sims = np.round(sims, ROUND_SIMILARITY)
                        if skip_same_id:
                            sims[indexes[:, None] == ids[None, :]] = -np.inf
                        best = _keep_best(best, indexes, ids, sims, k)
                        bars = _bars(best, indexes, k)
                        continue
                    at_query, at_row = np.divmod(np.flatnonzero(sims >= bars[:, None]), len(ids))
                    found = indexes[at_query], ids[at_row], sims[at_query, at_row]
                    fits = np.isfinite(found[2]) & ~(skip_same_id & (found[0] == found[1]))
                    pending.append(tuple(c[fits] for c in found))
                    n_pending += len(pending[-1][0])
                    if n_pending > len(block):
                        best, pending, n_pending = _merged(best, pending, k), [], 0
                        bars = _bars(best, indexes, k)
            best = _merged(best, pending, k)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], names=[query_id, id_column, "similarity"])

        passes.append(corpus.select(F.col(id_column).cast("bigint"), vector).mapInArrow(run, schema))
    if not passes:
        return corpus.sparkSession.createDataFrame([], schema + ", rank int")
    candidates = passes[0]
    if len(passes) > 1:
        candidates = stage(candidates, "neighbour-block")
        for other in passes[1:]:
            candidates = candidates.unionByName(stage(other, "neighbour-block"))
    order = [F.desc("similarity"), F.col(id_column)]
    return top_n_per_group(candidates, [query_id], order, k, F.col(id_column))

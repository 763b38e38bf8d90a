"""Nearest neighbours by inverted lists: approximate with a few lists per query, or exact with what lists exclude.

Centres are fitted on a bounded sample; every row then belongs to the list of its most similar centre. A search compares
a query only with the rows of the `probes` lists whose centres are most similar to it. How far a list reaches is known,
as the largest angle between its centre and a row, and angles obey the triangle inequality: a row of a list is at least
angle(query, centre) - reach away. With `exact`, lists that this does not rule out are searched as well, so that the
result is that of comparing all pairs.

The rows of a list are kept in slices of bounded size, and the queries that probe a list are dealt likewise, so neither a list with a third of
the rows nor one that all queries probe gathers in one task. What leaves a task is `k` rows per query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stage
from .similarity import BLOCK_FLOATS, ROUND_SIMILARITY, _keep_best, _slices, best_prototype, column_matrix, nearest_neighbours, unit_rows
from .skew import top_n_per_group

# Rows that centres are fitted on, lists, and rows and queries of a task's share of a list.
MOST_FITTED = 100_000
MOST_LISTS = 4096
SLICE_ROWS = 50_000
SLICE_QUERIES = 10_000
# Rows whose true neighbours say how many lists a search must probe, and the recall wanted on them: somewhat more than
# the 0.9 that other queries are to have.
CALIBRATED_ON = 200
RECALL = 0.93
# Room for rounding where angles are compared.
ANGLE_MARGIN = 1e-6


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def fit_centres(rows: DataFrame, vector: str, n_lists: int | None = None, id_column: str = "vec_id", most_fitted: int = MOST_FITTED,
                seed: int = 42) -> DataFrame:
    """`(idx, vector)`: centres by k-means (cosine) on at most `most_fitted` rows, those of the smallest hash of their id.

    Without `n_lists` there are as many as twice the root of the number of rows, at most MOST_LISTS. Rows without length are
    not fitted on; a table of only such rows has a single centre without length.
    """
    spark = rows.sparkSession
    usable = rows.where(F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False)))
    head = rows.where(F.size(vector) > 0).select(F.size(vector).alias("d")).first()
    dim = head["d"] if head else 1
    if usable.isEmpty():
        return spark.createDataFrame([(0, [0.0] * dim)], "idx bigint, vector array<double>")
    wanted = n_lists or max(1, round(2 * rows.count() ** 0.5))
    wanted = max(1, min(wanted, MOST_LISTS, BLOCK_FLOATS // dim))
    sample = stage(usable.orderBy(F.xxhash64(id_column), id_column).limit(most_fitted).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")), "neighbour-sample")
    model = KMeans(k=wanted, seed=seed, distanceMeasure="cosine", maxIter=10).fit(sample)
    centres = unit_rows(np.array(model.clusterCenters()))
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "idx bigint, vector array<double>")


@dataclass
class InvertedLists:
    """The rows by list and slice, as a written table `(id, vector, list, slice)`, and on the driver a few numbers per list:
    centres (lists x components), numbers of rows, of slices, and the largest angle to a row."""

    rows: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    slices: np.ndarray
    reach: np.ndarray

    @classmethod
    def build(cls, corpus: DataFrame, centres: DataFrame, id_column: str = "vec_id", vector: str = "embedding",
              slice_rows: int = SLICE_ROWS) -> InvertedLists:
        """Every row of the corpus is indexed. A null vector, or one without length, counts as a zero vector."""
        at = centres.orderBy("idx").toArrow()  # at most MOST_LISTS rows
        indexes, matrix = np.asarray(at["idx"], "int64"), np.array(at["vector"].to_pylist(), float)
        if len(matrix) > MOST_LISTS or (indexes != np.arange(len(matrix))).any():
            raise ValueError(f"centres must be numbered from 0 and at most {MOST_LISTS}")
        narrow = corpus.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).alias("vector"))
        listed = stage(best_prototype(narrow, "vector", centres).select("id", "vector", F.col("best_idx").alias("list"), "best_similarity"), "neighbour-lists")
        has_length = F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
        least = F.min(F.when(has_length, F.col("best_similarity")).otherwise(F.lit(-1.0)))
        sizes, reach = np.zeros(len(matrix), np.int64), np.zeros(len(matrix))
        for row in listed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), least.alias("least")).collect():  # a row per list
            sizes[row["list"]], reach[row["list"]] = row["n"], angles(np.array(row["least"]))
        slices = np.maximum(1, -(-sizes // slice_rows))
        per_list = F.get(F.array(*[F.lit(int(n)) for n in slices]), F.col("list").cast("int"))
        rows = listed.select("id", "vector", "list", F.pmod(F.xxhash64("id", "vector"), per_list).cast("int").alias("slice"))
        return cls(stage(rows, "neighbour-index"), unit_rows(matrix), sizes, slices, reach)

    def _probed(self, queries: DataFrame, chosen) -> DataFrame:
        """`(query_id, vector, floor, list)`: the lists that `chosen(cosines, vectors, floors)` marks for each query."""
        centres, dim = self.centres, self.centres.shape[1]

        def run(batches):
            for batch in batches:
                rows = unit_rows(column_matrix(batch.column(1), dim))
                for part in _slices(len(rows), len(centres)):
                    marked = chosen(rows[part] @ centres.T, rows[part], np.asarray(batch.column(2).fill_null(np.nan), "float64")[part])
                    of_row, of_list = np.nonzero(marked)
                    own = batch.slice(part.start, part.stop - part.start).take(pa.array(of_row))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(of_list, pa.int64())], names=["query_id", "vector", "floor", "list"])

        kind = queries.schema["vector"].dataType.simpleString()
        return queries.mapInArrow(run, f"query_id bigint, vector {kind}, floor double, list bigint")

    def _compared(self, probes: DataFrame, k: int, skip_same_id: bool) -> DataFrame:
        """`(query_id, id, similarity)`: for each query the best rows of each slice of its lists."""
        dim = self.centres.shape[1]
        counts = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / SLICE_QUERIES).cast("int").alias("parts"))  # at most MOST_LISTS rows
        slices = F.get(F.array(*[F.lit(int(n)) for n in self.slices]), F.col("list").cast("int"))
        of_queries = probes.join(F.broadcast(counts), "list").select(
            "list", F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "query_id", "vector")
        of_rows = self.rows.join(F.broadcast(counts), "list").select(
            "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "slice", "id", "vector")

        def best_of(asked: pa.Table, rows: pa.Table) -> pa.Table:
            best = (np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))
            if len(asked) and len(rows):
                query_ids = np.asarray(asked["query_id"], "int64")
                own, every = unit_rows(column_matrix(asked["vector"], dim)), np.asarray(rows["id"], "int64")
                others = unit_rows(column_matrix(rows["vector"], dim))
                for part in _slices(len(others), len(own)):
                    sims = np.round(own @ others[part].T, ROUND_SIMILARITY)
                    if skip_same_id:
                        sims[query_ids[:, None] == every[part][None, :]] = -np.inf
                    best = _keep_best(best, query_ids, every[part], sims, k)
            return pa.table([pa.array(c) for c in best], names=["query_id", "id", "similarity"])

        cell = ["list", "part", "slice"]
        return of_queries.groupBy(*cell).cogroup(of_rows.groupBy(*cell)).applyInArrow(best_of, "query_id bigint, id bigint, similarity double")

    def search(self, queries: DataFrame, k: int, probes: int, id_column: str = "vec_id", vector: str = "embedding",
               exact: bool = False, skip_same_id: bool = True) -> DataFrame:
        """`(query_id, id, similarity, rank)`: the `k` most similar rows to each query among its `probes` most similar
        lists, of equals those of the smallest id. With `exact`, the `k` most similar of all rows. Query ids must be unique."""
        asked = queries.select(F.col(id_column).cast("bigint").alias("query_id"), F.col(vector).alias("vector"), F.lit(None).cast("double").alias("floor"))

        def closest(cosines, vectors, floors):
            marked = np.zeros(cosines.shape, bool)
            near = np.argsort(-np.round(cosines, ROUND_SIMILARITY), axis=1, kind="stable")[:, :probes]
            np.put_along_axis(marked, near, True, axis=1)
            return marked

        order = [F.desc("similarity"), F.col("id")]
        found = self._compared(stage(self._probed(asked, closest), "neighbour-probes"), k, skip_same_id)
        if not exact:
            return top_n_per_group(found, ["query_id"], order, k, F.col("id"))
        first = stage(top_n_per_group(found, ["query_id"], order, k, F.col("id")), "neighbour-first")
        # what the k-th row so far leaves to beat; a query with fewer rows must see all lists
        floors = first.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("floor"))
        reach = self.reach

        def possible(cosines, vectors, floors):
            least = angles(cosines) - reach - ANGLE_MARGIN  # no row of the list is nearer than this
            known = ~np.isnan(floors) & (np.abs(vectors).max(axis=1) > 0)
            limit = np.where(known, angles(np.nan_to_num(floors)), np.inf)
            return (least <= limit[:, None] + ANGLE_MARGIN) & ~closest(cosines, vectors, floors)

        rest = asked.drop("floor").join(floors, "query_id", "left").select("query_id", "vector", "floor")
        more = self._compared(stage(self._probed(rest, possible), "neighbour-probes"), k, skip_same_id)
        both = first.select("query_id", "id", "similarity").unionByName(more)
        return top_n_per_group(both, ["query_id"], order, k, F.col("id"))

    def probes_for(self, k: int, recall: float = RECALL, n_queries: int = CALIBRATED_ON) -> int:
        """The fewest lists to probe for this share of the `k` true neighbours, over `n_queries` rows of the index (those
        of the smallest hash of their id) against all rows. How many that is depends on the data: many where
        vectors have no groups."""
        chosen = stage(self.rows.where(F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(n_queries)
                       .select("id", "vector"), "neighbour-trials")
        true = nearest_neighbours(self.rows.select("id", "vector"), chosen, k, "id", "vector")
        lists = self.rows.select("id", "list").distinct()
        met = true.join(lists, "id").select("query_id", "list").collect()  # k rows for each query, but for copies of an id
        vectors = {r["id"]: r["vector"] for r in chosen.collect()}
        if not met:
            return 1
        own = unit_rows(np.array([vectors[r["query_id"]] for r in met], float))
        cosines = np.round(own @ self.centres.T, ROUND_SIMILARITY)
        ranks = np.argsort(np.argsort(-cosines, axis=1, kind="stable"), axis=1)
        needed = np.sort(ranks[np.arange(len(met)), [r["list"] for r in met]]) + 1
        return int(needed[min(len(needed), max(1, int(np.ceil(recall * len(needed))))) - 1])

    def compared_pairs(self, queries: DataFrame, probes: int, id_column: str = "vec_id", vector: str = "embedding") -> int:
        """How many pairs of a query and a row an approximate search compares."""
        centres, sizes, dim = self.centres, self.sizes, self.centres.shape[1]

        def run(batches):
            for batch in batches:
                rows = unit_rows(column_matrix(batch.column(0), dim))
                near = np.argsort(-np.round(rows @ centres.T, ROUND_SIMILARITY), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([pa.array([int(sizes[near].sum())])], names=["pairs"])

        return queries.select(vector).mapInArrow(run, "pairs bigint").agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]


def approximate_neighbours(corpus: DataFrame, queries: DataFrame, k: int, n_lists: int | None = None, probes: int | None = None,
                           id_column: str = "vec_id", vector: str = "embedding", exact: bool = False) -> DataFrame:
    """`(query_id, id, similarity, rank)` by inverted lists over the whole corpus; without `probes`, as many lists as
    `probes_for` finds."""
    index = InvertedLists.build(corpus, fit_centres(corpus, vector, n_lists, id_column), id_column, vector)
    return index.search(queries, k, probes or index.probes_for(k), id_column, vector, exact).withColumnRenamed("id", id_column)

"""Inverted lists against all pairs."""

import numpy as np
import pytest

from conftest import SF_SMALL
from glossaframe.operators import neighbours, similarity

SCHEMA = "vec_id bigint, embedding array<double>"


def rows_of(found):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.similarity, 6)) for r in found.collect())


@pytest.fixture(scope="module")
def standard(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")


def test_recall_of_every_50th_row_against_all(standard):
    queries = standard.where("vec_id % 50 = 0")
    exact = {(r.query_id, r.vec_id) for r in similarity.nearest_neighbours(standard, queries, 10).collect()}
    centres = neighbours.fit_centres(standard, "embedding")
    index = neighbours.InvertedLists.build(standard, centres)
    rows, n_queries = standard.count(), queries.count()
    assert index.sizes.sum() == rows
    probes = index.probes_for(10)
    found = {(r.query_id, r.id) for r in index.search(queries, 10, probes).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    pairs = index.compared_pairs(queries, probes)
    print(f"{probes} of {len(index.centres)} lists, recall {len(found & exact) / len(exact):.3f}, {pairs / rows / n_queries:.3f} of all pairs")
    assert pairs < 0.7 * rows * n_queries  # vectors without groups: half of all lists are needed
    every = {(r.query_id, r.id) for r in index.search(queries, 10, len(index.centres)).collect()}
    assert every == exact


@pytest.mark.parametrize("probes", [1, 3])
def test_bounds_make_it_exact(spark, monkeypatch, probes):
    """Crowded lists, ties, copies, zero and null vectors; lists and queries in many slices."""
    monkeypatch.setattr(neighbours, "SLICE_QUERIES", 7)
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in v] for v in rng.integers(-2, 3, (300, 3))] + [[1.0, 1.0, 0.5]] * 150 + [[0.0] * 3] * 3 + [None]
    table = spark.createDataFrame(list(enumerate(vectors)), SCHEMA).repartition(4)
    queries = table.where("vec_id % 5 = 0")
    centres = neighbours.fit_centres(table, "embedding", 9)
    index = neighbours.InvertedLists.build(table, centres, slice_rows=20)
    found = index.search(queries, 8, probes, exact=True).withColumnRenamed("id", "vec_id")
    assert rows_of(found) == rows_of(similarity.nearest_neighbours(table, queries, 8))


def test_bounds_leave_lists_out(spark):
    """On rows in clear groups a search by bounds compares few lists and still gives what all pairs give."""
    rng = np.random.default_rng(4)
    groups = np.eye(12)[rng.integers(0, 12, 400)] + rng.normal(scale=0.02, size=(400, 12))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(groups)], SCHEMA)
    index = neighbours.InvertedLists.build(table, neighbours.fit_centres(table, "embedding", 12))
    assert index.probes_for(3, recall=1.0) <= 3
    assert index.compared_pairs(table, index.probes_for(3)) < 0.35 * 400 * 400
    found = index.search(table.where("vec_id % 50 = 0"), 3, 1, exact=True).withColumnRenamed("id", "vec_id")
    assert rows_of(found) == rows_of(similarity.nearest_neighbours(table, table.where("vec_id % 50 = 0"), 3))


def test_tables_without_rows_or_length(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert neighbours.approximate_neighbours(none, none, 3).collect() == []
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None)], SCHEMA)
    assert rows_of(neighbours.approximate_neighbours(zero, zero, 2)) == rows_of(similarity.nearest_neighbours(zero, zero, 2))
    one = spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA)
    assert neighbours.approximate_neighbours(one, one, 3).collect() == []


def test_bad_centres_are_refused(spark):
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    with pytest.raises(ValueError, match="numbered"):
        neighbours.InvertedLists.build(table, spark.createDataFrame([(1, [1.0] * 64)], "idx bigint, vector array<double>"))

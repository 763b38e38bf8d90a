import pytest

from glossaframe.operators import similarity


def test_repeated_ids_at_the_border_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_FLOATS", 6)  # three rows of two numbers
    vectors = spark.createDataFrame([(i, [1.0, float(k)]) for k, i in enumerate([1, 2, 3, 3, 3, 4, 5])], "idx bigint, vector array<double>")
    blocks = [list(indexes) for indexes, _ in similarity._blocks(vectors, "idx", "vector")]
    assert sorted(i for b in blocks for i in b) == [1, 2, 3, 3, 3, 4, 5] and max(map(len, blocks)) <= 3
    monkeypatch.setattr(similarity, "BLOCK_FLOATS", 4)
    with pytest.raises(ValueError, match="more than 2 rows"):
        list(similarity._blocks(vectors, "idx", "vector"))
    monkeypatch.setattr(similarity, "BLOCK_FLOATS", 1)
    assert [list(i) for i, _ in similarity._blocks(vectors.where("idx != 3"), "idx", "vector")] == [[1], [2], [4], [5]]


def test_few_pairs_are_ranked(spark, monkeypatch):
    """The nearest of all pairs with ties, zero and null vectors and repeated ids, while most pairs are never ranked."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(np.round(rng.normal(size=(300, 4)), 1))]
    rows += [(300 + i, rows[i][1]) for i in range(40)] + [(500, [0.0] * 4), (501, None), (7, [1.0, 0.0, 0.0, 0.0])]
    monkeypatch.setattr(similarity, "PAIRS_AT_ONCE", 343 * 10)
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    unit = similarity.unit_rows(np.array([v or [0.0] * 4 for _, v in rows]))
    ids = np.array([i for i, _ in rows])
    sims = np.round(unit @ unit.T, 9)
    for skip in (True, False):
        expected = set()
        for query in set(ids.tolist()):
            pairs = sorted((-s, int(i)) for q in np.flatnonzero(ids == query) for s, i in zip(sims[q], ids) if not (skip and i == query))[:3]
            expected |= {(query, i, rank) for rank, (_, i) in enumerate(pairs, 1)}
        got = similarity.nearest_neighbours(vectors.coalesce(1), vectors, 3, skip_same_id=skip).collect()
        assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == expected


def test_bars_let_through_what_may_still_be_kept():
    import numpy as np

    best = np.array([1, 1, 2, 4, 4]), np.array([5, 6, 7, 8, 9]), np.array([0.9, 0.5, 0.7, 0.3, 0.2])
    bars = similarity._bars(best, np.array([1, 2, 3, 4, 4]), 2)
    assert np.allclose(bars, [0.5, -np.inf, -np.inf, 0.2, 0.2]) and (bars <= [0.5, 0, 0, 0.2, 0.2]).all()
    queries, rows, values = similarity._merged(best, [(np.array([2, 1]), np.array([1, 4]), np.array([0.7, 0.5000000001]))], 2)
    assert (queries.tolist(), rows.tolist(), values.tolist()) == ([1, 1, 2, 2, 4, 4], [5, 4, 1, 7, 8, 9], [0.9, 0.5, 0.7, 0.7, 0.3, 0.2])

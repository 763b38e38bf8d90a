"""Codes against plain rounds of Lloyd over all vectors."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from conftest_llm import SF_SMALL
from glossaframe.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, code string"


def plain(rows, parts=16, entries=64, rounds=2):
    """({(id, vector): (code, error, label_error)}, digest) of rows (id, vector, label), all usable."""
    cut = np.array([[math.floor(x * 256) for x in v] for _, v, _ in rows], object).reshape(len(rows), parts, -1)
    firsts = {}
    for k, (i, v, _) in enumerate(rows):
        if i is not None and (i not in firsts or v < rows[firsts[i]][1]):
            firsts[i] = k
    books = [[cut[firsts[i], p].tolist() for i in sorted(firsts)[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for k in range(len(rows)):
                own[nearest(p, cut[k, p])[1]].append(cut[k, p])
            books[p] = [[sum(c) // len(some) for c in zip(*some)] if some else e for some, e in zip(own, books[p])]
    found = [[nearest(p, cut[k, p]) for p in range(parts)] for k in range(len(rows))]
    errors = [sum(d for d, _ in f) for f in found]
    of_label = {}
    for (_, _, label), e in zip(rows, errors):
        of_label[label] = of_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((i is None, i or 0, "".join(f"{k:02x}" for _, k in f), e, of_label[label]) for (i, _, label), f, e in zip(rows, found, errors)), digest


def same(rows, found, **options):
    wanted, digest = plain(rows, **options)
    assert sorted((r.id is None, r.id or 0, r.code, r.error, r.label_error) for r in found) == wanted
    assert {r.codebooks_sha256 for r in found} == {digest}


def test_standard_table(spark):
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    same([(r.vec_id, r.embedding, r.label) for r in table.collect()], vector_codes.encode_vectors(table).collect())


def test_many_blocks_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 64)
    monkeypatch.setattr(vector_codes, "LEAF_POINTS", 2)
    rng = np.random.default_rng(5)
    vectors = (rng.integers(-3, 4, (500, 8)) / 256).tolist() + [[0.0] * 8] * 150 + rng.normal(size=(100, 8)).astype("f4").tolist()
    rows = [(i, [float(np.float32(x)) for x in v], i % 3 if i % 5 else None) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    for entries in (1, 5, 64):
        same(rows, vector_codes.encode_vectors(table, parts=4, entries=entries).collect(), parts=4, entries=entries)


def test_odd_rows(spark):
    good = [float(np.float32(0.01 * k - 0.3)) for k in range(64)]
    odd = [(1, good, 1, "x", "x"), (2, None, 1, "x", "x"), (3, [*good[:-1], None], 1, "x", None), (4, [*good[:-1], float("nan")], 1, "x", "x"),
           (5, [float("-inf"), *good[1:]], None, "x", "x"), (6, good[::-1], None, "y", "y"), (None, good, None, "x", "x"), (1, good, 2, "x", "x"),
           (1, good[::-1], 1, "x", "x"), (9, [0.0] * 64, 1, None, None)]
    kept = [(i, v, label) for i, v, label, *_ in odd if v is not None and None not in v and all(map(math.isfinite, v))]
    same(kept, vector_codes.encode_vectors(spark.createDataFrame(odd, SCHEMA)).collect())
    assert vector_codes.encode_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vector_codes.encode_vectors(spark.createDataFrame(odd[1:5], SCHEMA)).collect() == []


def test_trees_cover_and_divide():
    rng = np.random.default_rng(1)
    cut = rng.integers(-100, 100, (3, 400, 4))
    forest = vector_codes.Forest.unpacked(vector_codes.Forest.grown(cut).packed())
    for k in range(len(forest.centre)):
        own = forest.points[forest.low[k]: forest.high[k]]
        away = np.sqrt(((own - forest.points[forest.centre[k]]) ** 2).sum(axis=1))
        assert away.max() == pytest.approx(forest.radius[k])
        below = range(forest.first[k], forest.last[k])
        if len(below):  # children divide their node's range, lie within half its radius, and are further than that apart
            assert [forest.low[c] for c in below] == [forest.low[k], *[forest.high[c] for c in below][:-1]] and forest.high[below[-1]] == forest.high[k]
            assert max(forest.radius[c] for c in below) <= forest.radius[k] / 2
            centres = forest.points[forest.centre[list(below)]]
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)) + np.eye(len(centres)) * 1e9
            assert apart.min() > forest.radius[k] / 2
        else:
            assert len(own) <= vector_codes.LEAF_POINTS or forest.radius[k] == 0
    for part in range(3):
        assert (forest.points[part * 400: part * 400 + 400] == cut[part][forest.rows[part * 400: part * 400 + 400]]).all()


def test_whole_nodes_are_assigned():
    """Far apart groups need no exact comparison, and cumulative sums are those of the points."""
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [5000, 0], [0, 5000]])
    cut = (centres[rng.integers(0, 3, 300)] + rng.integers(-20, 20, (300, 2)))[None]
    forest, books = vector_codes.Forest.grown(cut), centres[None]
    ranges = [(low, high) for low, high, _ in forest.assigned(books) if len(low)]
    assert sum(len(low) for low, _ in ranges) == 3
    counts, sums = forest.sums(books)
    near = ((cut[0][:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert counts[0].tolist() == np.bincount(near, minlength=3).tolist()
    assert sums[0].tolist() == [cut[0][near == k].sum(axis=0).tolist() for k in range(3)]


def test_bad_vectors_are_refused():
    with pytest.raises(ValueError):
        vector_codes.scaled(pa.array([[1.0, 2.0], [1.0]]), 1)
    with pytest.raises(ValueError):
        vector_codes.scaled(pa.array([[1e9, 2.0]]), 1)

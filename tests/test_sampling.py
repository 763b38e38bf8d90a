"""Samples, similarity, skew handling, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaframe.operators import labelers, sampling, similarity, skew
from glossaframe.operators.similarity import nearest_neighbours


def cosine(a, b):
    la, lb = np.linalg.norm(a), np.linalg.norm(b)
    return 0.0 if la == 0 or lb == 0 else float(np.dot(a, b) / (la * lb))


def vectors(spark, n=120, dim=6, seed=3, zero=(0, 7)):
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(n, dim)).astype("float32")
    made[list(zero)] = 0
    if n > 21:
        made[20] = made[21]
    rows = [(i + 1, [float(x) for x in v]) for i, v in enumerate(made)]
    return made.astype("float64"), spark.createDataFrame(rows, "_rid bigint, v array<float>").repartition(5)


def greedy(made, k):
    picked = [0]
    while len(picked) < min(k, len(made)):
        rest = [i for i in range(len(made)) if i not in picked]
        picked.append(min(rest, key=lambda i: (round(max(cosine(made[i], made[p]) for p in picked), 12), i)))
    return [p + 1 for p in picked]


@pytest.mark.parametrize("candidates", [1, 4, 512])
def test_diverse_equals_plain_greedy(spark, monkeypatch, candidates):
    monkeypatch.setattr(sampling, "DIVERSE_CANDIDATES", candidates)
    made, frame = vectors(spark)
    k = 12 if candidates > 1 else 5
    picks = [r["_rid"] for r in sampling.sample_diverse(frame, k, "v").orderBy("pick").collect()]
    assert picks == greedy(made, k)


def test_diverse_takes_all_when_asked_for_more(spark):
    _, frame = vectors(spark, n=9)
    assert sampling.sample_diverse(frame, 50, "v").count() == 9


def test_diverse_sample_of_texts(workspace, rides_csv):
    workspace.load_table(rides_csv, "posts")
    encoder = labelers.BatchEncoder("index", lambda: lambda texts: [[float(len(t)), 0.0] for t in texts])
    workspace.sample_rows("posts", 2, method="diverse", where="tone = 'low'", text_column="content", encoder=encoder,
                          columns=["content"], new_table="posts_sample")
    sample = workspace.table("posts_sample")
    assert sample.count() == 2 and sample.columns == workspace.table("posts").columns
    assert workspace.tables["posts_sample"].source == "posts[sample:diverse]"


def test_random_sample(workspace, rides_csv):
    workspace.load_table(rides_csv, "posts")
    sample = workspace.sample_rows("posts", 2, where="tone = 'low'", columns=["content", "tone"])
    assert sample.columns == ["_rid", "content", "tone"] and sample.count() == 2
    for wrong in (dict(method="odd"), dict(method="stratified"), dict(method="diverse")):
        with pytest.raises(ValueError):
            workspace.sample_rows("posts", 2, **wrong)
    with pytest.raises(ValueError, match="positive"):
        workspace.sample_rows("posts", 0)


def test_random_sample_is_the_head_of_the_random_order(spark):
    frame = spark.range(1, 3001).select(F.col("id").alias("_rid"))
    small = {r["_rid"] for r in frame.orderBy(sampling.random_order(5), "_rid").limit(777).collect()}
    assert {r["_rid"] for r in sampling.sample_random(frame, 777, seed=5).collect()} == small
    assert sampling.sample_random(frame, 9999, seed=5).count() == 3000


def test_stratified_quota_on_one_dominant_stratum(spark):
    frame = spark.range(1, 2001).select(F.col("id").alias("_rid"), F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("s"))
    counts = {r["s"]: r["count"] for r in sampling.sample_stratified(frame, "s", 15).groupBy("s").count().collect()}
    assert counts == {**{i: 15 for i in range(7)}, 99: 15}


def test_null_stratum_is_a_stratum(spark):
    frame = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(1, 21)], "_rid bigint, s string")
    assert sampling.sample_stratified(frame, "s", 3).count() == 6


@pytest.mark.parametrize("block", [6, 60, 10_000])
def test_neighbours_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK_FLOATS", block * 6)
    monkeypatch.setattr(similarity, "PAIRS_AT_ONCE", 500)
    made, frame = vectors(spark, n=60)
    queries = frame.where("_rid <= 15")
    got = {(r["query_id"], r["rank"]): (r["_rid"], round(r["similarity"], 6))
           for r in nearest_neighbours(frame, queries, 4, "_rid", "v").collect()}
    for q in range(15):
        best = sorted((-round(cosine(made[q], made[i]), 9), i) for i in range(60) if i != q)[:4]
        for rank, (s, i) in enumerate(best, 1):
            assert got[(q + 1, rank)] == (i + 1, round(-s, 6) + 0.0)
    assert len(got) == 60


@pytest.mark.parametrize("block", [2, 1000])
def test_best_prototype_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK_FLOATS", block * 6)
    made, frame = vectors(spark, n=40)
    protos = made[10:17]
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(protos)], "idx bigint, vector array<double>")
    for r in similarity.best_prototype(frame, "v", table).collect():
        sims = [round(cosine(made[r["_rid"] - 1], p), 9) for p in protos]
        assert r["best_idx"] == sims.index(max(sims))
        assert r["best_similarity"] == pytest.approx(max(sims), abs=1e-8)


def test_vectors_of_another_length_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "_rid bigint, v array<float>")
    table = spark.createDataFrame([(0, [1.0, 0.0])], "idx bigint, vector array<double>")
    with pytest.raises(Exception, match="must have 2 entries"):
        similarity.best_prototype(frame, "v", table).collect()


def test_cosine_expression(spark):
    from glossaframe.functions.vectors import cosine_similarity

    made, frame = vectors(spark, n=10)
    pairs = frame.select("_rid", "v").crossJoin(frame.where("_rid = 3").select(F.col("v").alias("w")))
    for r in pairs.select("_rid", cosine_similarity(F.col("v"), F.col("w")).alias("s")).collect():
        assert r["s"] == pytest.approx(cosine(made[r["_rid"] - 1], made[2]), abs=1e-9)


# ---- skew ------------------------------------------------------------------------------------------------


def test_top_n_of_a_dominant_group(spark):
    frame = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("g"), F.col("id").alias("x"))
    got = skew.top_n_per_group(frame, ["g"], [F.desc("x")], 3, F.col("x"))
    brute = {}
    for i in range(3000):
        brute.setdefault(i % 50 if i % 3 == 0 else -1, []).append(i)
    expected = {(g, rank): x for g, xs in brute.items() for rank, x in enumerate(sorted(xs, reverse=True)[:3], 1)}
    assert {(r["g"], r["rank"]): r["x"] for r in got.collect()} == expected


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_key_join_is_complete(spark, how):
    left = spark.range(1000).select(F.col("id").alias("x"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 400).cast("int").alias("k"))
    right = spark.range(0, 300).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("y"))
    hot = skew.hot_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows")), "k")
    assert 7 in [r["k"] for r in hot.collect()]
    joined = skew.join_skewed(left, right, "k", hot, F.col("x"), how)
    plain = left.join(right, "k", how)
    assert sorted(map(tuple, joined.select("x", "k", "y").collect())) == sorted(map(tuple, plain.select("x", "k", "y").collect()))
    assert skew.hot_keys(right.withColumn("n_rows", F.lit(1)), "k") is None


def test_enrichment_of_a_hot_content(spark, tmp_path):
    from glossaframe.operators import enrich
    from glossaframe.operators.cache import JudgementCache

    rows = spark.range(1, 601).select(F.col("id").alias("_rid"), F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.col("id").cast("string")).alias("t"))
    found = enrich.derive_column(rows, "v", ["t"], "p", "string", labelers.ColumnLabeler("echo", lambda p: F.to_json(F.struct(
        F.get_json_object(p, "$.t").alias("value")))), cache=JudgementCache(spark, str(tmp_path / "c")), table="t")
    assert found.df.count() == 600 and found.df.where("v = t").count() == 600
    assert found.counters().first()["calls"] == 401


def coverage(every, ids, picked):
    """The largest chord from a vector to its nearest pick."""
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    chosen = unit[[ids.index(i) for i in picked]]
    return float(np.sqrt(np.maximum(0, 2 - 2 * (unit @ chosen.T).max(axis=1))).max())


@pytest.mark.parametrize("block, partitions", [(4_000_000, 5), (64, 5), (1, 1)])
def test_coresets_cover_as_exact_picks_do(spark, monkeypatch, block, partitions):
    """Blocks of any size: n picks whose radius is at most twice that of exact greedy picks."""
    monkeypatch.setattr(sampling, "CORESET_FLOATS", block)
    rng = np.random.default_rng(11)
    every = rng.normal(size=(40, 8))[rng.integers(0, 40, 1200)] + rng.normal(size=(1200, 8)) * 0.3
    ids = list(range(5, 1205))
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, every)], "_rid bigint, v array<double>").repartition(partitions)
    for n in (1, 12):
        found = {r["pick"]: r["_rid"] for r in sampling.sample_diverse_coreset(table, n, "v").collect()}
        assert sorted(found) == list(range(1, n + 1)) and len({*found.values()}) == n
        exact = [r["_rid"] for r in sampling.sample_diverse(table, n, "v").collect()]
        assert coverage(every, ids, found.values()) <= 2 * coverage(every, ids, exact)


def test_coresets_of_one_block_are_exact_and_odd_rows(spark):
    _, table = vectors(spark)
    one = table.coalesce(1)
    rows = sampling.sample_diverse_coreset(one, 9, "v").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sampling.sample_diverse(one, 9, "v").collect()))
    odd = spark.createDataFrame([(1, None), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (2, [0.0, 0.0]), (3, [0.0, 2.0])], "_rid bigint, v array<float>")
    assert {r["_rid"] for r in sampling.sample_diverse_coreset(odd, 10, "v").collect()} == {1, 2, 3}
    assert sampling.sample_diverse_coreset(odd.where("false"), 3, "v").count() == 0
    with pytest.raises(ValueError):
        sampling.sample_diverse_coreset(odd, 0, "v")
    texts = odd.select("_rid", F.col("_rid").cast("string").alias("t")).where("_rid > 1")
    assert sampling.sample_rows(texts, 2, method="diverse_coreset", text_column="t", encoder=labelers.HashingEncoder(16)).count() == 2

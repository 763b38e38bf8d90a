"""Mined and proposed taxonomies and phrases, topics."""

import json
import random

import pytest
from pyspark.sql import functions as F

from glossaframe.functions.text import infer_polarity, polarity_of
from glossaframe.operators import labelers, mining, topics
from glossaframe.operators.runs import frequent_runs

TEXTS = [
    "The dock is far from the station. Far from the station!", "Honestly far from the station, and rusty.",
    "It feels rusty and heavy", "feels RUSTY and heavy", "Great views", None, "",
]


@pytest.fixture
def posts(spark):
    rows = [(i, t, "neg" if i <= 4 else "pos") for i, t in enumerate(TEXTS, 1)]
    return spark.createDataFrame(rows, "_rid bigint, content string, mood string").repartition(3)


def brute_support(texts, low, high):
    counts = {}
    for text in texts:
        words = ["".join(c for c in w.lower()).strip(".,!") for w in (text or "").split()]
        runs = {" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)}
        for run in runs:
            counts[run] = counts.get(run, 0) + 1
    return counts


@pytest.mark.parametrize("prune", [False, True])
def test_support_counts_rows(posts, prune):
    got = {r["phrase"]: r["support"] for r in mining.phrase_support(posts, "content", 2, 4, 2, prune).collect()}
    assert got == {p: n for p, n in brute_support(TEXTS, 2, 4).items() if n >= 2}


@pytest.mark.parametrize("low,high", [(1, 1), (1, 3), (2, 6), (3, 4)])
def test_levels_change_nothing(posts, low, high):
    pruned = mining.phrase_support(posts, "content", low, high, 2, True).collect()
    assert sorted(map(tuple, pruned)) == sorted(map(tuple, mining.phrase_support(posts, "content", low, high, 2).collect()))
    assert mining.phrase_support(posts, "content", low, high, 50, True).isEmpty()


@pytest.mark.parametrize("least", [2, 3])
def test_closed_phrases_against_all_pairs(spark, least):
    """Many overlapping runs, words that repeat in a row, and rows too short for a run."""
    rng = random.Random(least)
    texts = [" ".join(rng.choices(["a", "b", "c", "dd"], weights=[6, 3, 2, 1], k=rng.randint(0, 14))) for _ in range(40)] + ["a", "", None, "a a a a a a a a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "_rid bigint, content string").repartition(3)
    support = {p: n for p, n in brute_support(texts, 2, 5).items() if n >= least}
    closed = {p: n for p, n in support.items()
              if not any(n == m and f" {p} " in f" {q} " and len(q.split()) == len(p.split()) + 1 for q, m in support.items())}
    runs = frequent_runs(rows, "content", 2, 5, least)
    assert {r.phrase: r.support for r in runs.supports(2).collect()} == support
    assert {r.phrase: r.support for r in runs.supports(2, closed=True).collect()} == closed
    assert 0 < len(closed) < len(support)
    top = {r.label: r.support for r in mining.mine_phrases(rows, "content", high=5, min_support=least, max_phrases=7, closed=True).collect()}
    assert top == dict(sorted(closed.items(), key=lambda x: (-x[1], -len(x[0].split()), x[0]))[:7])


def test_fewer_rows_are_listed_than_all_runs(spark):
    """What each level lists are places where two frequent runs overlap, not all runs of the texts."""
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) + " the same end" for i in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "_rid bigint, content string")
    runs = frequent_runs(rows, "content", 1, 4, 2)
    listed = {n: sum(len(r["at"]) for r in places.collect()) for n, places in runs.places.items()}
    assert listed == {1: 90, 2: 60, 3: 30}  # of 30 * 53, 30 * 52 and 30 * 51 runs
    assert [r.phrase for r in runs.levels[3].collect()] == ["the same end"]


def test_phrases_with_variants_and_examples(posts):
    found = {r["label"]: r for r in mining.mine_phrases(posts, "content", parent_angle_column="mood", parent_angle_value="neg",
                                                        min_support=2, low=2, high=4).collect()}
    top = found["far from the station"]
    assert top["support"] == 2 and list(top["example_rids"]) == [1, 2] and top["parent_angle"] == "neg"
    assert list(top["variants"]) == ["Far from the station!", "far from the station,", "far from the station."]
    assert list(found["rusty and heavy"]["variants"]) == ["RUSTY and heavy", "rusty and heavy"]
    with pytest.raises(ValueError, match="0 rows"):
        mining.mine_phrases(posts, "content", where="mood = 'none'")
    assert mining.mine_phrases(posts, "content", where="_rid >= 6").isEmpty()


def test_flat_and_hierarchical_taxonomies(posts):
    flat = mining.mine_taxonomy(posts, "content", max_categories=3, min_support=2, max_share=0.5, min_chars=4, include_other=True).collect()
    assert {(r["label"], r["support"]) for r in flat} == {("rusty", 3), ("feels", 2), ("from", 2), ("other", 0)}
    tree = mining.mine_taxonomy(posts, "content", taxonomy_shape="hierarchical", min_support=2, max_share=0.5, min_chars=4, max_parent_categories=2).collect()
    # "feels rusty" holds both parents and belongs to the more frequent one
    assert {r["parent"] for r in tree} == {"rusty"} and "feels rusty" in {r["label"] for r in tree}
    assert ("rusty", "rusty and heavy") in {(r["parent"], r["label"]) for r in tree}
    assert all(r["label"].count("rusty") == 1 for r in tree)


def test_proposed_taxonomy_from_a_sample(workspace, rides_csv):
    seen = []

    def proposer(request):
        seen.append(json.loads(request))
        return json.dumps({"categories": [{"label": " mechanical ", "definition": "parts that fail"}, {"label": ""}, "x"],
                           "recommended_column_name": "ride_angle", "notes": "n"})

    workspace.load_table(rides_csv, "posts")
    categories, notes = workspace.discover_taxonomy("posts", "content", "negative_ride_notes", proposer,
                                                    where="tone = 'low'", sample_size=4)
    assert [tuple(r) for r in categories.collect()] == [(None, "mechanical", "parts that fail")]
    assert notes["recommended_column_name"] == "ride_angle"
    assert seen[0]["target_polarity"] == "negative" and len(seen[0]["rows"]) == 4
    _, notes = workspace.discover_taxonomy("posts", "content", "g", lambda r: '{"categories": [{"label": "a"}]}', sampling_method="stratified",
                                           stratify_by="tone", sample_size=1)
    assert notes == {"recommended_column_name": "g_label"}
    for answer in ("no json", '{"categories": []}', "[]"):
        with pytest.raises(ValueError):
            workspace.discover_taxonomy("posts", "content", "g", lambda r, a=answer: a)


def test_proposed_tree_and_phrases(workspace, rides_csv):
    workspace.load_table(rides_csv, "posts")
    tree = {"categories": [
        {"parent_label": "vehicle", "children": [{"child_label": "drivetrain", "child_definition": "chain and gears"}, {"child_label": " "}]},
        {"parent_label": "", "children": [{"child_label": "lost"}]}]}
    categories, _ = workspace.discover_taxonomy("posts", "content", "g", lambda r: json.dumps(tree), taxonomy_shape="hierarchical")
    assert [tuple(r) for r in categories.collect()] == [("vehicle", "drivetrain", "chain and gears")]
    phrases = {"phrases": [{"canonical_phrase": "drivetrain", "definition": "d", "variants": ["chain and gears"], "example_rids": [1], "parent_angle": "vehicle"},
                           {"canonical_phrase": "bare", "variants": "none"}]}
    found, notes = workspace.discover_issue_phrases("posts", "content", "pain points", lambda r: json.dumps(phrases),
                                                    parent_angle_column="tone", parent_angle_value="low")
    rows = {r["label"]: (r["variants"], r["example_rids"], r["parent_angle"]) for r in found.collect()}
    assert rows == {"drivetrain": (["chain and gears"], [1], "vehicle"), "bare": ([], [], "")}
    assert notes == {"recommended_column_name": "issue_phrase"}
    assigned = workspace.assign_taxonomy("posts", "content", "phrase", "g", [r.asDict() for r in found.collect()],
                                         labeler=labelers.RuleLabeler("r", [("wobbles", "drivetrain")], "bare"))
    assert assigned.df.where("phrase = 'drivetrain'").count() == 1


def test_payload_is_cut_and_never_null(posts, spark):
    rows = spark.createDataFrame([(1, "z" * 900), (2, None)], "_rid bigint, t string")
    assert {r["_rid"]: len(r["text"]) for r in mining.proposal_payload(rows, "t").collect()} == {1: 500, 2: 0}


@pytest.mark.parametrize("text,plain,whole", [
    ("negative_ride_notes", "negative", None), ("some posts", "positive", None), ("neg and praise", "negative", "negative"),
    ("用户吐槽", "negative", None), ("卖点", "positive", "positive"), ("weather", None, None), ("pain points", None, None)])
def test_polarity(spark, text, plain, whole):
    row = spark.range(1).select(infer_polarity(F.lit(text)).alias("p"), infer_polarity(F.lit(text), whole_words=True).alias("w")).first()
    assert (row["p"], row["w"]) == (plain, whole)
    assert polarity_of(text) == plain
    assert polarity_of("pain points", phrases=True) == "negative"


# ---- topics ---------------------------------------------------------------------------------------------


def test_topics_of_two_clear_groups(spark):
    texts = ["apple banana cherry"] * 8 + ["engine wheel brake"] * 8 + ["", None]
    rows = spark.createDataFrame([(i, t, i <= 17) for i, t in enumerate(texts, 1)], "_rid bigint, t string, keep boolean")
    asked = labelers.ColumnLabeler("namer", lambda p: F.when(p.contains("apple"), F.lit('{"value": "fruit salad with a long name"}')))
    found = topics.discover_topics(rows, "t", where="keep", n_topics=2, encoder=labelers.HashingEncoder(64), labeler=asked, outlier_share=0.0)
    by_rid = {r["_rid"]: (r["topic_id"], r["topic_label"]) for r in found.df.collect()}
    assert len({by_rid[i] for i in range(1, 9)}) == 1 and len({by_rid[i] for i in range(9, 17)}) == 1
    assert by_rid[1][1] == "fruit salad with a long name"[:20] and by_rid[9][1] == "brake、engine、wheel"[:20]
    assert by_rid[17] == (-1, "other") and by_rid[18] == (None, None)
    described = {r["label"]: r for r in found.topics.collect()}
    assert described["brake、engine、wheel"[:20]]["n"] == 8 and len(described["brake、engine、wheel"[:20]]["examples"]) == 3
    with pytest.raises(ValueError, match="at least 5"):
        topics.discover_topics(rows.limit(3), "t", encoder=labelers.HashingEncoder(8))


def test_topic_names_without_labeler_are_the_keywords(spark):
    made = spark.createDataFrame([(0, "a、b" * 20, ["x"])], "topic_id int, keywords string, examples array<string>")
    assert topics.name_topics(made).first()["label"] == "a、b" * 20


def test_the_bar_of_top_runs_loses_none(spark):
    """The top of all runs, with ties, an upper limit and closed runs, from words that reach a bar far above `min_rows`."""
    from glossaframe.operators import runs as word_runs

    rng = random.Random(5)
    weights = [60 / (i + 1) for i in range(60)]
    texts = [" ".join(rng.choices([f"w{i}" for i in range(60)], weights=weights, k=rng.randint(0, 30))) for _ in range(200)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "_rid bigint, content string").repartition(3)
    support = {p: n for p, n in brute_support(texts, 2, 4).items() if 2 <= n <= 90}

    def first(some, k):
        return sorted(((p, n) for p, n in some.items()), key=lambda x: (-x[1], -len(x[0].split()), x[0]))[:k]

    for k in (1, 12, 100_000):
        for prune in (False, True):
            _, found = word_runs.top_runs(rows, "content", 2, 4, 2, 90, k, prune=prune)
            assert first({r.phrase: r.support for r in found.collect()}, k) == first(support, k)
    mined, _ = word_runs.top_runs(rows, "content", 2, 4, 2, 90, 12)
    # rare words were not looked at
    assert mined.levels[1].count() < 60 and mined.levels[1].agg(F.min("support")).first()[0] > 10
    top = mining.mine_phrases(rows, "content", high=4, max_phrases=12, max_share=0.45, prune=False).collect()
    assert {(r.label, r.support) for r in top} == set(first({p: n for p, n in support.items() if n <= int(len(texts) * 0.45)}, 12))


def test_places_are_picked_out_inside_the_rows(spark, monkeypatch):
    """Few frequent runs need no shuffle of the places; many of them give the same."""
    from glossaframe.operators import runs as word_runs

    rows = spark.createDataFrame([(i, f"a b c x{i} a b") for i in range(6)], "_rid bigint, content string")
    at = spark.createDataFrame([(1, [(0, 5), (1, 6)])], "_rid bigint, at array<struct<pos: int, h: bigint>>")
    plan = word_runs._kept(at, spark.createDataFrame([(5,)], "h bigint"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

    def listed():
        found = frequent_runs(rows, "content", 1, 3, 2)
        return {n: sorted((r["_rid"], [tuple(p) for p in r["at"]]) for r in places.collect()) for n, places in found.places.items()}

    inside = listed()
    monkeypatch.setattr(word_runs, "LISTED", 0)
    assert listed() == inside


def test_children_hold_their_parent(spark):
    """Runs around the parents only, against all runs of the texts."""
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "of"], weights=[5, 4, 3, 2, 6], k=rng.randint(0, 9))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "_rid bigint, content string")
    tree = mining.mine_taxonomy(rows, "content", taxonomy_shape="hierarchical", min_chars=4, max_parent_categories=2,
                                max_child_categories_per_parent=1000).collect()
    words = {p: n for p, n in brute_support(texts, 1, 1).items() if n >= 2 and len(p) >= 4}
    parents = sorted(words, key=lambda p: (-words[p], p))[:2]
    runs = {p: n for p, n in brute_support(texts, 2, 3).items() if n >= 2}
    expected = {(next(x for x in parents if x in p.split()), p, n) for p, n in runs.items() if set(parents) & set(p.split())}
    assert {(r.parent, r.label, r.support) for r in tree} == expected and len(expected) < len(runs)

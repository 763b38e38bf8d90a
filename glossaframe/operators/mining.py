"""Mining a taxonomy or canonical phrases from all rows, and cleaning proposals made by a model from a sample."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, keys
from ..functions.text import explode_values, norm_words, polarity_of, surface_forms, text_or_empty, with_ngrams
from ..scratch import stage
from ..sources.row_ids import RID
from .enrich import check_choice, check_columns
from .filters import drill_down
from .runs import frequent_runs, row_counts, top_runs
from .sampling import sample_rows
from .skew import fan_out, spread, top_n_per_group


def _with_grams(df: DataFrame, text_column: str, low: int, high: int) -> DataFrame:
    """`_rid` and the distinct word runs of each row."""
    tokens = norm_words(text_or_empty(F.col(f"`{text_column}`")))
    return with_ngrams(df.select(RID, tokens.alias("__tokens")), "__tokens", "__grams", low, high).select(RID, "__grams")


def _dealt(df: DataFrame) -> DataFrame:
    """Rows in enough partitions to cut texts in: as they are, unless a table comes in fewer splits than a shuffle has."""
    return df if df.rdd.getNumPartitions() >= fan_out(df.sparkSession) else spread(df)


def phrase_support(df: DataFrame, text_column: str, low: int, high: int, min_rows: int, prune: bool = False) -> DataFrame:
    """`(phrase, support)`: in how many rows each word run occurs, if in at least `min_rows`.

    Runs are made distinct inside each row, so a plain count is the number of rows and combines map-side.
    `prune` goes level by level: a run is only looked at where both its runs of one word less are frequent, so the long
    tail of rare runs is never listed. The result is the same.
    """
    if prune:
        return frequent_runs(df, text_column, low, high, min_rows).supports(low).select("phrase", "support")
    grams = explode_values(_with_grams(df, text_column, low, high), [], F.col("__grams"), "phrase")
    counted = grams.groupBy("phrase").agg(F.count(F.lit(1)).alias("support"))
    return counted.where(F.col("support") >= min_rows)


def _runs_around(tokens: DataFrame, words: Sequence[str], low: int, high: int, min_rows: int) -> DataFrame:
    """`(phrase, support)` of the runs of `low`..`high` words that hold one of a short list of words. `tokens` has a written
    column `words`."""
    listed = list(words)
    stands = F.filter(F.transform("words", lambda w, i: F.when(w.isin(listed), i)), lambda i: i.isNotNull())

    def of(n: int) -> Column:
        first = F.flatten(F.transform("stands", lambda i: F.sequence(F.greatest(i - n + 1, F.lit(0)), F.least(i, F.size("words") - n))))
        return F.when(F.size("words") >= n, F.transform(F.array_distinct(first), lambda i: F.concat_ws(" ", F.slice("words", i + 1, n)))).otherwise(
            F.array().cast("array<string>"))

    holding = tokens.select(RID, "words", stands.alias("stands"))
    grams = explode_values(holding, [], F.array_distinct(F.concat(*[of(n) for n in range(low, high + 1)])), "phrase")
    return grams.groupBy("phrase").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_rows)


def _first_rows(hits: DataFrame) -> DataFrame:
    """`(phrase, example_rids)` from distinct `(phrase, _rid)`."""
    first = top_n_per_group(hits, ["phrase"], [F.col(RID)], fixed.EXAMPLE_ROWS, F.col(RID))
    return first.groupBy("phrase").agg(F.array_sort(F.collect_list(RID)).alias("example_rids"))


def examples_of(df: DataFrame, text_column: str, phrases: Sequence[str], low: int, high: int) -> DataFrame:
    """`(phrase, example_rids)`: the first rows that contain each of a short list of phrases."""
    wanted = F.array(*[F.lit(p) for p in phrases])
    return _first_rows(explode_values(_with_grams(df, text_column, low, high), [RID], F.array_intersect("__grams", wanted), "phrase"))


def variant_counts(occurrences: DataFrame) -> DataFrame:
    """`(phrase, variant, n)`: every way in which each phrase of `(_rid, phrase, variant)` is written, and how often."""
    return occurrences.groupBy("phrase", "variant").agg(F.count(F.lit(1)).alias("n"))


def variants_of(occurrences: DataFrame, limit: int | None = None) -> DataFrame:
    """`(phrase, variants)`: the ways in which each phrase is written, most frequent first; all of them unless `limit`
    says how many."""
    counted = variant_counts(occurrences)
    if limit is not None:
        counted = top_n_per_group(counted, ["phrase"], [F.desc("n"), F.col("variant")], limit, F.col("variant"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "variant")))
    return counted.groupBy("phrase").agg(F.transform(ordered, lambda s: s["variant"]).alias("variants"))


def _definition(support: Column) -> Column:
    return F.concat(F.lit("found in "), support.cast("string"), F.lit(" rows"))


def _scope_size(scope: DataFrame) -> int:
    rows = scope.count()
    if rows == 0:
        raise ValueError("filter returned 0 rows, nothing to inspect")
    return rows


def mine_taxonomy(df: DataFrame, text_column: str, where: str | None = None, max_categories: int = 8,
                  taxonomy_shape: str = "flat", max_parent_categories: int = 5, max_child_categories_per_parent: int = 5,
                  min_support: int = 2, max_share: float = 1.0, min_chars: int = 1,
                  include_other: bool = False) -> DataFrame:
    """`(parent, label, definition, support, example_rids)` from how many rows use which words, over all rows.

    Words and runs in fewer than `min_support` rows are no candidates; nothing else is left out unless `max_share` (of
    the rows) or `min_chars` say so. Flat: the most frequent words. Hierarchical: such words
    are parents, and the most frequent two- and three-word runs that hold a parent are its children.
    """
    check_columns(df, [RID, text_column])
    check_choice("taxonomy_shape", taxonomy_shape, ["flat", "hierarchical"])
    if max_categories <= 0:
        raise ValueError("max_categories must be positive")
    scope = df.where(F.expr(where)) if where else df
    rows = _scope_size(scope)
    scope = _dealt(scope.select(RID, text_column))
    most = int(rows * max_share)
    high = 1 if taxonomy_shape == "flat" else 3
    tokens = stage(scope.select(RID, norm_words(text_or_empty(F.col(f"`{text_column}`"))).alias("words")), "tokens")
    terms = row_counts(tokens, min_support).where(
        (F.col("support") <= most) & (F.length("phrase") >= min_chars)
    ).orderBy(F.desc("support"), "phrase")
    if taxonomy_shape == "flat":
        chosen = terms.limit(max_categories).select(F.lit(None).cast("string").alias("parent"), F.col("phrase").alias("label"), "support")
    else:
        parents = stage(terms.limit(max_parent_categories).select(F.col("phrase").alias("word"), F.col("support").alias("parent_support")), "parents")
        # other runs are nobody's children
        around = _runs_around(tokens, [r["word"] for r in parents.collect()], 2, high, min_support)
        runs = around.where(F.col("support") <= most).select(
            "phrase", "support", F.explode(F.array_distinct(F.split("phrase", " "))).alias("word")
        )
        # the parents are as few as max_parent_categories says
        owned = runs.join(F.broadcast(parents), "word").groupBy("phrase", "support").agg(
            F.min_by("word", F.struct(-F.col("parent_support"), F.col("word"))).alias("parent")
        )
        chosen = top_n_per_group(
            owned, ["parent"], [F.desc("support"), F.col("phrase")], max_child_categories_per_parent, F.col("phrase")
        ).select("parent", F.col("phrase").alias("label"), "support")
    chosen = stage(chosen, "categories")
    labels = [r["label"] for r in chosen.select("label").collect()]  # as few as the caller asked for
    examples = examples_of(scope, text_column, labels, 1, high).withColumnRenamed("phrase", "label")
    out = chosen.join(examples, "label", "left").select("parent", "label", _definition(F.col("support")).alias("definition"), "support", "example_rids")
    if include_other:
        rest = chosen.select("parent").distinct() if taxonomy_shape == "hierarchical" else df.sparkSession.createDataFrame([(None,)], "parent string")
        out = out.unionByName(rest.select(
            "parent", F.lit(fixed.OUTLIER_LABEL).alias("label"), F.lit("anything else").alias("definition"),
            F.lit(0).cast("bigint").alias("support"), F.array().cast("array<bigint>").alias("example_rids"),
        ))
    return out


def _phrase_scope(df: DataFrame, text_column: str, where: str | None, parent_angle_column: str | None, parent_angle_value,
                  max_phrases: int) -> DataFrame:
    check_columns(df, [RID, text_column])
    if max_phrases <= 0:
        raise ValueError("max_phrases must be positive")
    return drill_down(df, where, parent_angle_column, parent_angle_value).select(RID, text_column)


def _top_phrases(scope: DataFrame, text_column: str, max_phrases: int, low: int, high: int, min_support: int, max_share: float,
                 prune: bool, closed: bool) -> tuple[DataFrame, DataFrame]:
    """`(phrase, support)` of the most frequent phrases, written once, and `(_rid, phrase, variant)` for each of their places."""
    rows, dealt = _scope_size(scope), _dealt(scope)
    if closed and not prune:
        raise ValueError("closed phrases are mined level by level: closed needs prune")
    runs, supports = top_runs(dealt, text_column, low, high, min_support, max(1, int(rows * max_share)), max_phrases, closed, prune)
    top = stage(supports.orderBy(F.desc("support"), F.desc("words"), "phrase").limit(max_phrases), "phrases")
    chosen = top.collect()  # at most max_phrases
    if not chosen:
        places = dealt.select(RID, F.lit("").alias("phrase"), F.lit("").alias("variant")).limit(0)
    else:
        hashes: dict[int, list[int]] = {}
        for r in chosen:
            hashes.setdefault(r["words"], []).append(r["h"])
        # only rows that hold a chosen phrase are cut once more, for the way it is written
        at = runs.places_of(hashes).groupBy(RID).agg(F.collect_list(F.struct("pos", "h")).alias("at"))
        named = F.create_map(*[F.lit(x) for r in chosen for x in (r["h"], r["phrase"])])
        surface = surface_forms(text_or_empty(F.col(f"`{text_column}`")))
        cut = stage(scope.join(at, RID).select(RID, surface.alias("words"), "at"), "phrase-rows")
        written = F.transform("at", lambda p: F.struct(named[p["h"]].alias("phrase"), F.concat_ws(" ", F.slice(
            "words", p["pos"] + 1, F.size(F.split(named[p["h"]], " ")))).alias("variant")))
        places = explode_values(cut, [RID], written, "p").select(RID, "p.phrase", "p.variant")
    return top.select("phrase", "support"), places


def mine_phrases(df: DataFrame, text_column: str, where: str | None = None, parent_angle_column: str | None = None,
                 parent_angle_value=None, max_phrases: int = 10, low: int = 2, high: int = 6,
                 min_support: int = 2, max_share: float = 1.0, prune: bool = True, max_variants: int | None = None,
                 closed: bool = False) -> DataFrame:
    """`(label, definition, support, variants, example_rids, parent_angle)`: the most frequent phrases of all rows.

    A phrase is a run of `low`..`high` words, compared without case and outer punctuation; the ways it is
    written are its variants, all of them unless `max_variants` says how many. A phrase of very many variants is better
    read from `mine_phrase_variants`. Equal support is ordered by length, longest first, then by text. `closed` leaves out
    phrases that are part of a phrase one word longer (of at most `high`) in as many rows.
    """
    scope = _phrase_scope(df, text_column, where, parent_angle_column, parent_angle_value, max_phrases)
    top, places = _top_phrases(scope, text_column, max_phrases, low, high, min_support, max_share, prune, closed)
    places = stage(places, "phrase-places")
    examples = _first_rows(places.select("phrase", RID).distinct())
    variants = variants_of(places, max_variants)
    parent = "" if parent_angle_value is None else str(parent_angle_value)
    return (
        top.join(examples, "phrase", "left").join(variants, "phrase", "left")
        .select(F.col("phrase").alias("label"), _definition(F.col("support")).alias("definition"), "support",
                "variants", "example_rids", F.lit(parent).alias("parent_angle"))
    )


def mine_phrase_variants(df: DataFrame, text_column: str, where: str | None = None, parent_angle_column: str | None = None,
                         parent_angle_value=None, max_phrases: int = 10, low: int = 2, high: int = 6,
                         min_support: int = 2, max_share: float = 1.0, prune: bool = True, closed: bool = False) -> DataFrame:
    """`(label, support, variant, n)`: the phrases of `mine_phrases` with every way in which they are written, a row each."""
    scope = _phrase_scope(df, text_column, where, parent_angle_column, parent_angle_value, max_phrases)
    top, places = _top_phrases(scope, text_column, max_phrases, low, high, min_support, max_share, prune, closed)
    return variant_counts(places).join(F.broadcast(top), "phrase").select(F.col("phrase").alias("label"), "support", "variant", "n")


# ---- proposals made by a model from a sample --------------------------------------------------------------


def proposal_payload(sample: DataFrame, text_column: str) -> DataFrame:
    """`(_rid, text)` of the rows shown to a proposer: at most 500 characters each, null as empty."""
    return sample.select(RID, F.substring(text_or_empty(F.col(f"`{text_column}`")), 1, fixed.PROPOSAL_TEXT_CHARS).alias("text"))


def clean_categories(proposal: DataFrame, raw: str, taxonomy_shape: str = "flat") -> DataFrame:
    """`(parent, label, definition)` from a proposer's JSON, trimmed, without blanks and malformed entries."""
    check_choice("taxonomy_shape", taxonomy_shape, ["flat", "hierarchical"])
    parsed = F.try_parse_json(raw)
    entries = F.explode(F.try_variant_get(parsed, "$.categories", "array<variant>")).alias("c")

    def text(path: str, of: str = "c") -> Column:
        return F.trim(F.coalesce(F.try_variant_get(F.col(of), path, "string"), F.lit("")))

    one = proposal.select(entries).where(F.schema_of_variant("c").startswith("OBJECT"))
    if taxonomy_shape == "flat":
        out = one.select(F.lit(None).cast("string").alias("parent"), text("$.label").alias("label"), text("$.definition").alias("definition"))
    else:
        children = F.explode(F.try_variant_get("c", "$.children", "array<variant>")).alias("k")
        out = one.select(text("$.parent_label").alias("parent"), children).where(
            (F.col("parent") != "") & F.schema_of_variant("k").startswith("OBJECT")
        ).select("parent", text("$.child_label", "k").alias("label"), text("$.child_definition", "k").alias("definition"))
    return out.where(F.col("label") != "")


def clean_phrases(proposal: DataFrame, raw: str) -> DataFrame:
    """`(label, definition, variants, example_rids, parent_angle)` from a proposer's JSON."""
    parsed = F.try_parse_json(raw)
    one = proposal.select(F.explode(F.try_variant_get(parsed, "$.phrases", "array<variant>")).alias("c"))
    one = one.where(F.schema_of_variant("c").startswith("OBJECT"))

    def text(path: str) -> Column:
        return F.trim(F.coalesce(F.try_variant_get("c", path, "string"), F.lit("")))

    def items(path: str, kind: str) -> Column:
        return F.coalesce(F.try_variant_get("c", path, kind), F.array().cast(kind))

    return one.select(
        text("$.canonical_phrase").alias("label"), text("$.definition").alias("definition"),
        items("$.variants", "array<string>").alias("variants"), items("$.example_rids", "array<bigint>").alias("example_rids"),
        text("$.parent_angle").alias("parent_angle"),
    ).where(F.col("label") != "")


Proposer = Callable[[str], str]


def _propose(df: DataFrame, text_column: str, request: dict, proposer: Proposer, sample_size: int, sampling_method: str,
             stratify_by: str | None, encoder, seed: int) -> tuple[DataFrame, dict]:
    """One proposer call over a sample of `sample_size` rows, which is what the driver holds."""
    import json

    sample = sample_rows(df, sample_size, method=sampling_method, stratify_by=stratify_by, text_column=text_column,
                         encoder=encoder, seed=seed)
    shown = [r.asDict() for r in proposal_payload(sample, text_column).orderBy(RID).collect()]
    if not shown:
        raise ValueError("filter returned 0 rows, nothing to inspect")
    answer = proposer(keys.canonical_json({**request, "text_column": text_column, "rows": shown}))
    try:
        notes = json.loads(answer)
    except (TypeError, json.JSONDecodeError) as error:
        raise ValueError(f"the proposer returned no JSON: {error}") from error
    return df.sparkSession.createDataFrame([(answer,)], "raw string"), notes if isinstance(notes, dict) else {}


def propose_taxonomy(df: DataFrame, text_column: str, goal: str, proposer: Proposer, where: str | None = None,
                     sample_size: int = 30, sampling_method: str = "random", stratify_by: str | None = None, encoder=None,
                     max_categories: int = 8, taxonomy_shape: str = "flat", granularity_preference: str = "both",
                     max_parent_categories: int = 5, max_child_categories_per_parent: int = 5, include_other: bool = True,
                     seed: int = 0) -> tuple[DataFrame, dict]:
    """Categories that a model proposes from a sample, cleaned, and its notes with the suggested column name."""
    check_columns(df, [text_column])
    check_choice("granularity_preference", granularity_preference, ["broad", "fine", "both"])
    scope = df.where(F.expr(where)) if where else df
    request = {
        "goal": goal, "target_polarity": polarity_of(goal, where), "max_categories": max_categories,
        "taxonomy_shape": taxonomy_shape, "granularity_preference": granularity_preference,
        "max_parent_categories": max_parent_categories,
        "max_child_categories_per_parent": max_child_categories_per_parent, "include_other": include_other,
    }
    raw, notes = _propose(scope, text_column, request, proposer, sample_size, sampling_method, stratify_by, encoder, seed)
    categories = clean_categories(raw, "raw", taxonomy_shape)
    if categories.isEmpty():
        raise ValueError("taxonomy discovery returned no categories")
    return categories, {"recommended_column_name": f"{goal}_label", **{k: v for k, v in notes.items() if v and k != "categories"}}


def propose_phrases(df: DataFrame, text_column: str, goal: str, proposer: Proposer, where: str | None = None,
                    parent_angle_column: str | None = None, parent_angle_value=None, sample_size: int = 40,
                    sampling_method: str = "random", stratify_by: str | None = None, encoder=None, max_phrases: int = 10,
                    include_other: bool = True, phrase_style: str = "canonical_issue", seed: int = 0) -> tuple[DataFrame, dict]:
    """Canonical phrases that a model proposes from a sample, cleaned, and its notes."""
    check_columns(df, [text_column])
    check_choice("phrase_style", phrase_style, fixed.PHRASE_STYLES)
    scope = drill_down(df, where, parent_angle_column, parent_angle_value)
    request = {
        "goal": goal, "phrase_style": phrase_style, "max_phrases": max_phrases, "include_other": include_other,
        "target_polarity": polarity_of(goal, where, None if parent_angle_value is None else str(parent_angle_value), phrases=True),
        "parent_angle_column": parent_angle_column, "parent_angle_value": parent_angle_value,
    }
    raw, notes = _propose(scope, text_column, request, proposer, sample_size, sampling_method, stratify_by, encoder, seed)
    phrases = clean_phrases(raw, "raw")
    if phrases.isEmpty():
        raise ValueError("phrase discovery returned no phrases")
    return phrases, {"recommended_column_name": "issue_phrase", **{k: v for k, v in notes.items() if v and k != "phrases"}}

"""Topics: cluster embeddings, describe the clusters by their words and rows, name them, join them back."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, values
from ..functions.text import explode_values, text_or_empty, words
from ..scratch import stage
from ..sources.row_ids import RID
from .enrich import check_columns, check_identifier
from .labelers import Request
from .similarity import best_prototype, unit_rows
from .skew import spread, top_n_per_group


def class_keywords(df: DataFrame, class_column: str, text_column: str, n: int = fixed.TOPIC_KEYWORDS) -> DataFrame:
    """`(class, term, score, rank)`: the words typical of each class by class-based TF-IDF.

    score = count of the term in the class * ln(1 + mean words per class / count of the term in all).
    """
    classed = df.where(F.col(class_column).isNotNull())
    terms = explode_values(classed, [F.col(class_column).alias("class")], words(text_or_empty(F.col(text_column))), "term")
    counts = stage(terms.groupBy("class", "term").agg(F.count(F.lit(1)).alias("tf")), "class-terms")
    per_class = counts.agg((F.sum("tf") / F.count_distinct("class")).alias("a")).first()["a"] or 0.0
    totals = counts.groupBy("term").agg(F.sum("tf").alias("total"))
    score = F.round(F.col("tf") * F.log(1 + F.lit(per_class) / F.col("total")), 6)
    scored = counts.join(totals, "term").select("class", "term", score.alias("score"))
    return top_n_per_group(scored, ["class"], [F.desc("score"), F.col("term")], n, F.col("term"))


def keyword_labels(keywords: DataFrame) -> DataFrame:
    """`(class, keywords)`: the ranked words of each class as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return keywords.groupBy("class").agg(
        F.array_join(F.transform(ordered, lambda s: s["term"]), fixed.KEYWORD_SEPARATOR).alias("keywords")
    )


def representatives(df: DataFrame, class_column: str, text_column: str, closeness: str, n: int = fixed.TOPIC_EXAMPLES) -> DataFrame:
    """`(class, _rid, text, rank)`: the rows closest to the centre of each class, texts cut to 100 characters."""
    rows = df.where(F.col(class_column).isNotNull()).select(
        F.col(class_column).alias("class"), RID, F.round(closeness, 9).alias("__close"),
        F.substring(text_or_empty(F.col(text_column)), 1, fixed.TOPIC_EXAMPLE_CHARS).alias("text"),
    )
    return top_n_per_group(rows, ["class"], [F.desc("__close"), F.col(RID)], n, F.col(RID)).drop("__close")


def name_topics(topics: DataFrame, labeler=None) -> DataFrame:
    """Add `label` to `(topic_id, keywords, examples)`: one labeler call per topic, the keywords without one."""
    if labeler is None:
        return topics.withColumn("label", F.col("keywords"))
    asked = topics.withColumn("payload", F.to_json(F.struct("keywords", "examples")))
    answered = stage(labeler.label(asked, "payload", "raw", Request("Name the topic of these keywords and examples.")), "topic-names")
    name = values.typed_value(values.answer_value_json(F.col("raw")), "string")
    label = F.substring(F.coalesce(F.when(name != "", name), F.col("keywords")), 1, fixed.TOPIC_LABEL_CHARS)
    return answered.withColumn("label", label).drop("payload", "raw")


@dataclass
class Topics:
    df: DataFrame
    topics: DataFrame


def discover_topics(df: DataFrame, text_column: str, where: str | None = None, n_topics: int | None = None,
                    topic_id_column: str = "topic_id", topic_label_column: str = "topic_label", encoder=None,
                    vector_column: str | None = None, labeler=None, outlier_share: float = 0.05, seed: int = 42,
                    most_topics: int = 50) -> Topics:
    """Add a topic number and a topic name; `-1` and `other` for outliers, NULL outside the filter.

    Without `n_topics` there are as many topics as the root of half the rows, at most `most_topics`.
    Outliers are rows without words and the given share of rows least similar to their centre.
    """
    check_columns(df, [RID, text_column] + ([vector_column] if vector_column else []))
    check_identifier(topic_id_column)
    check_identifier(topic_label_column)
    if encoder is None and vector_column is None:
        raise ValueError("topics need an encoder or a vector column")
    spark = df.sparkSession
    scope = df.where(F.expr(where)) if where else df
    rows = scope.count()
    if rows < fixed.MIN_TOPIC_ROWS:
        raise ValueError(f"only {rows} rows after filter: need at least {fixed.MIN_TOPIC_ROWS} for clustering")
    if vector_column is None:
        vectors = encoder.encode(spread(scope.select(RID, text_column)), text_column, "__v")
    else:
        vectors = scope.select(RID, text_column, F.col(vector_column).alias("__v"))
    has_length = F.coalesce(F.exists("__v", lambda x: x != 0), F.lit(False))
    vectors = stage(vectors.select(RID, F.col(text_column).alias("text"), "__v", has_length.alias("__usable")), "topic-vectors")
    k = n_topics or int(min(most_topics, max(2, round((rows / 2) ** 0.5))))
    usable = vectors.where("__usable").select(array_to_vector("__v").alias("features"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(usable)
    centres = unit_rows(np.array(model.clusterCenters()))
    table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "idx bigint, vector array<double>")
    scored = stage(best_prototype(vectors, "__v", table), "topic-scores")
    cut = scored.where("__usable").approxQuantile("best_similarity", [outlier_share], 0.001)[0] if outlier_share > 0 else -2.0
    inlier = F.col("__usable") & (F.col("best_similarity") >= F.lit(cut))
    assigned = scored.select(
        RID, "text", "best_similarity",
        F.when(inlier, F.col("best_idx")).otherwise(F.lit(fixed.OUTLIER_TOPIC)).cast("int").alias("topic_id"),
    )
    real = assigned.where(F.col("topic_id") != fixed.OUTLIER_TOPIC)
    sizes = assigned.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    keywords = keyword_labels(class_keywords(real, "topic_id", "text"))
    ranked = F.array_sort(F.collect_list(F.struct("rank", "text")))
    examples = representatives(real, "topic_id", "text", "best_similarity").groupBy("class").agg(
        F.transform(ranked, lambda s: s["text"]).alias("examples")
    )
    described = real.select("topic_id").distinct().join(keywords.withColumnRenamed("class", "topic_id"), "topic_id", "left")
    described = described.join(examples.withColumnRenamed("class", "topic_id"), "topic_id", "left")
    described = described.withColumn("keywords", F.coalesce("keywords", F.lit("")))
    named = stage(name_topics(described, labeler).select("topic_id", "label", "keywords", "examples"), "topics")
    # as many rows as there are clusters
    labels = F.broadcast(named.select("topic_id", F.col("label").alias("__label")))
    judged = assigned.join(labels, "topic_id", "left").select(
        RID, F.col("topic_id").alias("__id"), F.coalesce("__label", F.lit(fixed.OUTLIER_LABEL)).alias("__label")
    )
    kept = [c for c in df.columns if c not in (topic_id_column, topic_label_column)]
    out = df.select(*[F.col(f"`{c}`") for c in kept]).join(judged, RID, "left").select(
        *[F.col(f"`{c}`") for c in kept], F.col("__id").alias(topic_id_column), F.col("__label").alias(topic_label_column)
    )
    return Topics(out, named.join(sizes, "topic_id", "left"))

"""Vectors, diverse samples, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine_similarity
from ..operators import labelers, neighbours, sampling, similarity, topics
from ..sources import readers
from ..sources.row_ids import RID
from .enrichment import PROTOTYPES, label_prototypes
from .loading import documents
from .registry import path_of, query, read


@query("cosine_pairs", """
SELECT a.vec_id, b.vec_id AS next_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf_dir):
    """Each vector with the one after it."""
    table = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = table.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("next"))
    pairs = table.join(following, "vec_id")
    return pairs.select("vec_id", "next_id", F.round(cosine_similarity(F.col("embedding"), F.col("next")), 6).alias("similarity"))


@query("nearest_neighbours", """
SELECT query_id, vec_id, rank, round(round(sim, 9), 6) AS similarity FROM (
  SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS INTEGER) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id <> e.vec_id) WHERE rank <= 3""")
def nearest_neighbours(spark, sf_dir):
    table = read(spark, sf_dir, "embeddings")
    found = similarity.nearest_neighbours(table, table, 3)
    return found.select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


def _nearest_sql(candidates: str, k: int) -> str:
    """The k nearest of the pairs (q, e) that a FROM clause gives, for every query whose id is divisible by 50."""
    return f"""SELECT query_id, vec_id, rank, round(round(sim, 9), 6) AS similarity FROM (
  SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS INTEGER) AS rank
  FROM {candidates} WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id) WHERE rank <= {k}"""


@query("nearest_neighbours_in_lists", f"""WITH {PROTOTYPES},
r AS (SELECT vec_id, idx, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, idx) AS near FROM s),
probed AS (SELECT q.vec_id AS query_id, l.vec_id FROM r q JOIN b l ON q.idx = l.best_idx WHERE q.near <= 3)
""" + _nearest_sql("probed JOIN embeddings q ON q.vec_id = query_id JOIN embeddings e ON e.vec_id = probed.vec_id", 5))
def nearest_neighbours_in_lists(spark, sf_dir):
    """Every row in the list of its nearest label centre; every 50th vector against the rows of its three nearest lists."""
    table = read(spark, sf_dir, "embeddings")
    index = neighbours.InvertedLists.build(table, label_prototypes(spark, sf_dir))
    found = index.search(table.where("vec_id % 50 = 0"), 5, probes=3)
    return found.select("query_id", F.col("id").alias("vec_id"), "rank", F.round("similarity", 6).alias("similarity"))


@query("nearest_neighbours_by_bounds", _nearest_sql("embeddings q, embeddings e", 5))
def nearest_neighbours_by_bounds(spark, sf_dir):
    """Lists under fitted centres; after a first probe, only lists that may hold nearer rows are searched. Equals all pairs."""
    table = read(spark, sf_dir, "embeddings")
    found = neighbours.approximate_neighbours(table, table.where("vec_id % 50 = 0"), 5, probes=2, exact=True)
    return found.select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


def _greedy_sql(k: int) -> str:
    """The picks one after the other, each by its own subquery."""
    steps = ["r AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, embedding::DOUBLE[] AS v FROM embeddings)",
             "p1 AS (SELECT rid, v, 1 AS pick FROM r ORDER BY rid LIMIT 1)", "c1 AS (SELECT * FROM p1)"]
    for i in range(2, k + 1):
        steps.append(
            f"p{i} AS (SELECT r.rid, any_value(r.v) AS v, {i} AS pick FROM r, c{i - 1} c WHERE r.rid NOT IN (SELECT rid FROM c{i - 1}) "
            f"GROUP BY r.rid ORDER BY max(round(list_cosine_similarity(r.v, c.v), 12)), r.rid LIMIT 1)"
        )
        steps.append(f"c{i} AS (SELECT * FROM c{i - 1} UNION ALL SELECT * FROM p{i})")
    return "WITH " + ",\n".join(steps) + f"\nSELECT rid AS _rid, pick FROM c{k}"


@query("sample_diverse", _greedy_sql(8))
def sample_diverse(spark, sf_dir):
    return sampling.sample_diverse(readers.load(spark, path_of(sf_dir, "embeddings")), 8, "embedding")


@query("sample_diverse_coreset")
def sample_diverse_coreset(spark, sf_dir):
    return sampling.sample_diverse_coreset(read(spark, sf_dir, "embeddings"), 200, "embedding", "vec_id")


@query("sample_diverse_table", """SELECT count(*) AS n_rows, count(DISTINCT _rid) AS n_ids FROM (SELECT unnest(range(25)) AS _rid)""")
def sample_diverse_table(spark, sf_dir):
    """A diverse sample of texts, encoded on the way, saved as a table with all columns."""
    from ..workspace import Workspace

    workspace = Workspace(spark, encoder=labelers.HashingEncoder(128))
    workspace.register("documents", documents(spark, sf_dir), path_of(sf_dir, "documents"))
    workspace.sample_rows("documents", 25, method="diverse", text_column="text", new_table="documents_sample")
    return workspace.table("documents_sample").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(RID).alias("n_ids"))


@query("topic_keywords", r"""
WITH t AS (SELECT lang AS class, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: length(w) > 0)) AS term FROM documents),
c AS (SELECT class, term, count(*) AS tf FROM t GROUP BY class, term),
a AS (SELECT sum(tf)::DOUBLE / count(DISTINCT class) AS a FROM c),
f AS (SELECT term, sum(tf)::DOUBLE AS total FROM c GROUP BY term),
s AS (SELECT class, c.term, round(tf * ln(1 + a / total), 6) AS score FROM c JOIN f ON c.term = f.term, a)
SELECT class, term, score, CAST(row_number() OVER (PARTITION BY class ORDER BY score DESC, term) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY class ORDER BY score DESC, term) <= 8""")
def topic_keywords(spark, sf_dir):
    return topics.class_keywords(read(spark, sf_dir, "documents"), "lang", "text")


@query("topic_representatives", f"""WITH {PROTOTYPES},
c AS (SELECT vec_id, own AS class, sim FROM s WHERE own = idx)
SELECT class, _rid, rank FROM (
  SELECT class, vec_id + 1 AS _rid, CAST(row_number() OVER (PARTITION BY class ORDER BY round(sim, 9) DESC, vec_id) AS INTEGER) AS rank FROM c)
WHERE rank <= 3""")
def topic_representatives(spark, sf_dir):
    rows = readers.load(spark, path_of(sf_dir, "embeddings"))
    centres = label_prototypes(spark, sf_dir).select(F.col("idx").cast("int").alias("label"), F.col("vector").alias("centre"))
    close = rows.join(centres, "label").select(
        RID, "label", F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"),
        cosine_similarity(F.col("embedding"), F.col("centre")).alias("closeness"))
    return topics.representatives(close, "label", "text", "closeness").select("class", RID, "rank")


@query("topics")
def discover_topics(spark, sf_dir):
    """Clusters of the document texts, named by their words. Clustering has no SQL form."""
    found = topics.discover_topics(documents(spark, sf_dir), "text", n_topics=8, encoder=labelers.HashingEncoder(256))
    return found.df.select(RID, "doc_id", "topic_id", "topic_label")


@query("topics_of_vectors")
def topics_of_vectors(spark, sf_dir):
    rows = readers.load(spark, path_of(sf_dir, "embeddings")).withColumn("note", F.concat(F.lit("label "), F.col("label").cast("string")))
    found = topics.discover_topics(rows, "note", n_topics=10, vector_column="embedding", outlier_share=0.0)
    return found.topics.select("topic_id", "label", "n", "keywords")

"""Column enrichment and the memo of judgements."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.values import answer_value_json, typed_value
from ..operators import enrich, labelers, similarity, taxonomy
from ..operators.cache import JudgementCache
from ..scratch import new_path
from ..sources import readers
from ..sources.row_ids import RID
from .loading import documents
from .registry import path_of, query, read

KIND_PROMPT = "What kind of document is this?"
KIND_VALUES = ["license", "contact", "web", "other"]
KIND_RULES = [("license", "license"), ("@", "contact"), ("http", "web"), ("password|secret|api.?key", "credentials")]
KIND_SQL = """CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(text, '@') THEN 'contact'
       WHEN contains(lower(text), 'http') THEN 'web' WHEN regexp_matches(lower(text), 'password|secret|api.?key') THEN NULL
       ELSE 'other' END"""


def kind_labeler():
    # 'credentials' is not an allowed value: such rows become NULL
    return labelers.RuleLabeler("kind-rules", KIND_RULES, "other")


def new_cache(spark) -> JudgementCache:
    return JudgementCache(spark, new_path(spark, "judgements"))


@query("derive_enum", f"SELECT row_number() OVER (ORDER BY doc_id) AS _rid, doc_id, {KIND_SQL} AS kind FROM documents")
def derive_enum(spark, sf_dir):
    """The whole way: keys, labeler on distinct texts, memo, write-back join."""
    found = enrich.derive_column(documents(spark, sf_dir), "kind", ["text"], KIND_PROMPT, "enum", kind_labeler(),
                                 KIND_VALUES, cache=new_cache(spark), table="documents")
    return found.df.select(RID, "doc_id", "kind")


@query("derive_enum_inline", f"SELECT doc_id, {KIND_SQL} AS kind FROM documents")
def derive_enum_inline(spark, sf_dir):
    """No memo and an expression labeler: one narrow pass over the scan."""
    found = enrich.derive_column(documents(spark, sf_dir), "kind", ["text"], KIND_PROMPT, "enum", kind_labeler(), KIND_VALUES)
    return found.df.select("doc_id", "kind")


def _field(name: str):
    return lambda payload: F.get_json_object(payload, f"$.{name}")


def _quoted_word(payload, request):
    """Whether the word that the prompt quotes occurs."""
    word = request.prompt.split("'")[1]
    return F.to_json(F.struct(F.lower(payload).contains(word).alias("value")))


@query("derive_prompted", """
SELECT doc_id, contains(lower(text), 'license') AS on_license, contains(lower(text), 'refund') AS on_refund FROM documents""")
def derive_prompted(spark, sf_dir):
    """One labeler that answers from its request: two prompts give two columns."""
    labeler, cache, rows = labelers.PromptedLabeler("quoted-word", _quoted_word), new_cache(spark), documents(spark, sf_dir)
    for word in ("license", "refund"):
        rows = enrich.derive_column(rows, f"on_{word}", ["text"], f"Does it speak of '{word}'?", "boolean", labeler,
                                    cache=cache, table="documents").df
    return rows.select("doc_id", "on_license", "on_refund")


@query("derive_columns_apart", f"""
SELECT row_number() OVER (ORDER BY doc_id) AS _rid, doc_id, text, lang, source, n_chars, {KIND_SQL} AS kind,
  contains(lower(text), 'license') AS on_license, contains(lower(text), 'refund') AS on_refund FROM documents""")
def derive_columns_apart(spark, sf_dir):
    """Three columns as three narrow tables beside the documents, read together without an exchange."""
    from ..workspace import Workspace

    workspace = Workspace(spark, new_path(spark, "judgements"), columns_apart=True)
    workspace.register("documents", documents(spark, sf_dir), path_of(sf_dir, "documents"))
    workspace.derive_column("documents", "kind", ["text"], KIND_PROMPT, "enum", enum_values=KIND_VALUES, labeler=kind_labeler())
    for word in ("license", "refund"):
        workspace.derive_column("documents", f"on_{word}", ["text"], f"Does it speak of '{word}'?", "boolean",
                                labeler=labelers.PromptedLabeler("quoted-word", _quoted_word))
    return workspace.table("documents")


@query("derive_number", """
SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 10
  THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / 4 END AS k_number FROM events""")
def derive_number(spark, sf_dir):
    """Small values are answered as text, which is no number."""
    k = lambda p: F.get_json_object(_field("props")(p), "$.k").cast("bigint")

    def answer(p):
        return F.when(k(p) >= 10, F.concat(F.lit('{"value":'), (k(p) / 4).cast("string"), F.lit("}"))).otherwise(
            F.concat(F.lit('{"value":"'), k(p).cast("string"), F.lit('"}')))

    events = readers.load(spark, path_of(sf_dir, "events"))
    found = enrich.derive_column(events, "k_number", ["props"], "Read k.", "number", labelers.ColumnLabeler("read-k", answer),
                                 cache=new_cache(spark), table="events")
    return found.df.select("event_id", "k_number")


@query("derive_boolean", "SELECT doc_id, CASE WHEN n_chars % 10 = 0 THEN NULL ELSE n_chars > 1500 END AS is_long FROM documents")
def derive_boolean(spark, sf_dir):
    n = lambda p: _field("n_chars")(p).cast("bigint")

    def answer(p):
        return F.when(n(p) % 10 == 0, F.lit('{"value": 1}')).otherwise(
            F.concat(F.lit('{"value":'), (n(p) > 1500).cast("string"), F.lit("}")))

    found = enrich.derive_column(documents(spark, sf_dir), "is_long", ["n_chars"], "Is it long?", "boolean",
                                 labelers.ColumnLabeler("long", answer), cache=new_cache(spark), table="documents")
    return found.df.select("doc_id", "is_long")


@query("derive_string", """
SELECT doc_id, CASE WHEN lang = 'es' THEN NULL ELSE concat(upper(lang), ' from ', source) END AS origin FROM documents""")
def derive_string(spark, sf_dir):
    def answer(p):
        said = F.concat(F.upper(_field("lang")(p)), F.lit(" from "), _field("source")(p))
        return F.when(_field("lang")(p) == "es", F.lit("not json")).otherwise(F.to_json(F.struct(said.alias("value"))))

    found = enrich.derive_column(documents(spark, sf_dir), "origin", ["source", "lang"], "Where from?", "string",
                                 labelers.ColumnLabeler("origin", answer), cache=new_cache(spark), table="documents")
    return found.df.select("doc_id", "origin")


@query("derive_dry_run", f"""
SELECT row_number() OVER (ORDER BY doc_id) AS _rid, doc_id, {KIND_SQL} AS kind FROM documents ORDER BY doc_id LIMIT 20""")
def derive_dry_run(spark, sf_dir):
    found = enrich.derive_column(documents(spark, sf_dir), "kind", ["text"], KIND_PROMPT, "enum", kind_labeler(),
                                 KIND_VALUES, sample_size=20, cache=new_cache(spark), table="documents")
    return found.df.select(RID, "doc_id", "kind")


@query("derive_rerun_counters", f"""
WITH d AS (SELECT text, {KIND_SQL} AS kind FROM documents)
SELECT 1 AS run, COUNT(*) AS total, 0::BIGINT AS cache_hits, COUNT(DISTINCT text) AS calls,
  COUNT(*) FILTER (WHERE kind IS NULL) AS errors FROM d
UNION ALL
SELECT 2, COUNT(*), COUNT(*) FILTER (WHERE kind IS NOT NULL), COUNT(DISTINCT text) FILTER (WHERE kind IS NULL),
  COUNT(*) FILTER (WHERE kind IS NULL) FROM d""")
def derive_rerun_counters(spark, sf_dir):
    """Valid judgements are asked for once; only errors are asked again."""
    cache, table = new_cache(spark), documents(spark, sf_dir)
    out = None
    for run in (1, 2):
        found = enrich.derive_column(table, "kind", ["text"], KIND_PROMPT, "enum", kind_labeler(), KIND_VALUES,
                                     cache=cache, table="documents")
        one = found.counters().select(F.lit(run).alias("run"), "total", "cache_hits", "calls", "errors")
        out = one if out is None else out.unionByName(one)
    return out


@query("answer_validation", """
SELECT event_id,
  CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS as_number,
  CASE WHEN event_type = 'view' THEN json_extract_string(props, '$.k') END AS as_string,
  CASE WHEN event_type = 'purchase' THEN value > 10 END AS as_boolean
FROM events""")
def answer_validation(spark, sf_dir):
    """Each answer is valid for one type only: number, string, boolean, broken JSON, or no object."""
    k = F.get_json_object("props", "$.k")
    raw = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"value": '), k, F.lit("}")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"value": "'), k, F.lit('"}')))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"value": '), (F.col("value") > 10).cast("string"), F.lit("}")))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"value": '), k))
        .otherwise(F.concat(F.lit("["), k, F.lit("]")))
    )
    value = answer_value_json(raw)
    return read(spark, sf_dir, "events").select(
        "event_id", typed_value(value, "number").alias("as_number"), typed_value(value, "string").alias("as_string"),
        typed_value(value, "boolean").alias("as_boolean"),
    )


@query("derived_distribution", f"""
SELECT coalesce({KIND_SQL}, 'NULL') AS label, COUNT(*) AS n FROM documents GROUP BY 1""")
def derived_distribution(spark, sf_dir):
    found = enrich.derive_column(documents(spark, sf_dir), "kind", ["text"], KIND_PROMPT, "enum", kind_labeler(), KIND_VALUES,
                                 cache=new_cache(spark), table="documents")
    return found.distribution()


# ---- classifier, encoder --------------------------------------------------------------------------------


def _size_classifier():
    def make():
        def labels(texts):
            return ["long" if len(t) > 2000 else "medium" if len(t) > 500 else "short" for t in texts]

        return labels

    return labelers.BatchClassifier("text-size", make)


@query("classify_rules", """
SELECT doc_id, CASE WHEN length(text) > 2000 THEN 'long' WHEN length(text) > 500 THEN 'medium' ELSE 'short' END AS size_class
FROM documents""")
def classify_rules(spark, sf_dir):
    found = enrich.classify_column(documents(spark, sf_dir), "text", "size_class", _size_classifier(),
                                   cache=new_cache(spark), table="documents")
    return found.df.select("doc_id", "size_class")


@query("embed_hash", r"""
SELECT doc_id, 256 AS dim, CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length FROM documents""")
def embed_hash(spark, sf_dir):
    from ..functions.vectors import norm

    found = enrich.embed_column(documents(spark, sf_dir), "text", "vector", labelers.HashingEncoder(256))
    return found.df.select("doc_id", F.size("vector").alias("dim"), F.round(norm(F.col("vector")), 4).alias("length"))


WEIGHTED_WORDS = 256
WEIGHTS_SQL = rf"""
t AS (SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: length(w) > 0)) AS term FROM documents),
f AS (SELECT term, count(DISTINCT doc_id) AS n FROM t GROUP BY term ORDER BY n DESC, term LIMIT {WEIGHTED_WORDS}),
w AS (SELECT term, n, ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (n + 1.0::DOUBLE)) AS weight FROM f)"""


@query("word_weights", f"WITH {WEIGHTS_SQL} SELECT term, n AS n_rows, round(weight, 9) AS weight FROM w")
def word_weights(spark, sf_dir):
    fitted = labelers.WeightedEncoder.fit(documents(spark, sf_dir), "text", WEIGHTED_WORDS)
    rows = [(term, n, round(weight, 9)) for (term, n), weight in zip(fitted.frequencies, fitted.weights)]
    return spark.createDataFrame(rows, "term string, n_rows bigint, weight double")


@query("embed_weighted", f"""
WITH {WEIGHTS_SQL},
x AS (SELECT doc_id, term, count(*) * any_value(weight) AS x FROM t JOIN w USING (term) GROUP BY doc_id, term),
u AS (SELECT doc_id, term, (x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE AS x FROM x WHERE x <> 0),
l AS (SELECT doc_id, sqrt(sum(x * x)) AS length, count(*) AS n_terms FROM u GROUP BY doc_id),
d AS (SELECT a.doc_id, sum(a.x * b.x) AS dot FROM u a JOIN u b ON b.doc_id = a.doc_id + 1 AND b.term = a.term GROUP BY a.doc_id)
SELECT a.doc_id, coalesce(la.n_terms, 0) AS n_terms, round(coalesce(dot / (la.length * lb.length), 0.0), 6) AS next_similarity
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 LEFT JOIN l la ON la.doc_id = a.doc_id LEFT JOIN l lb ON lb.doc_id = b.doc_id
LEFT JOIN d ON d.doc_id = a.doc_id""")
def embed_weighted(spark, sf_dir):
    """Each text with the one after it, by weighted words."""
    from ..functions.vectors import cosine_similarity

    rows = documents(spark, sf_dir)
    found = enrich.embed_column(rows, "text", "vector", labelers.WeightedEncoder.fit(rows, "text", WEIGHTED_WORDS)).df.select("doc_id", "vector")
    following = found.select((F.col("doc_id") - 1).alias("doc_id"), F.col("vector").alias("next"))
    n_terms = F.size(F.filter("vector", lambda x: x != 0)).cast("bigint")
    return found.join(following, "doc_id").select(
        "doc_id", n_terms.alias("n_terms"), F.round(cosine_similarity(F.col("vector"), F.col("next")), 6).alias("next_similarity"))


# ---- taxonomies -----------------------------------------------------------------------------------------

FLAT_GOAL = "complaint_angles"
FLAT_RULES = [("worthless|refund", "value"), ("password|secret", "privacy"), ("license", "legal"), ("@", "__skip__")]


@query("assign_flat", """
SELECT doc_id, CASE WHEN n_chars <= 300 THEN NULL WHEN regexp_matches(lower(text), 'worthless|refund') THEN 'value'
  WHEN regexp_matches(lower(text), 'password|secret') THEN 'privacy' WHEN contains(lower(text), 'license') THEN NULL
  WHEN contains(text, '@') THEN NULL ELSE 'other' END AS angle FROM documents""")
def assign_flat(spark, sf_dir):
    found = taxonomy.assign_taxonomy(
        documents(spark, sf_dir), "text", "angle", FLAT_GOAL, ["value", {"label": "privacy", "definition": "data"}, "other"],
        labelers.RuleLabeler("angle-rules", FLAT_RULES, "other"), where="n_chars > 300", cache=new_cache(spark), table="documents",
    )
    return found.df.select("doc_id", "angle")


@query("assign_hier", """
SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(text, '@') THEN 'privacy' WHEN lang = 'x' THEN '' END AS angle,
  CASE WHEN contains(lower(text), 'license') THEN 'license terms' WHEN contains(text, '@') THEN 'mail address' END AS detail
FROM documents""")
def assign_hier(spark, sf_dir):
    rules = [
        ("license", {"parent": " legal ", "child": "license terms"}), ("@", {"parent": "privacy", "child": "mail address"}),
        ("http", {"parent": "privacy", "child": "license terms"}),
    ]
    pairs = [{"parent": "legal", "child": "license terms", "definition": "terms of use"},
             {"parent": "privacy", "child": "mail address", "definition": "a way to reach somebody"}]
    found = taxonomy.assign_taxonomy(
        documents(spark, sf_dir), "text", None, FLAT_GOAL, pairs, labelers.RuleLabeler("pair-rules", rules, "none"),
        taxonomy_shape="hierarchical", new_column_parent="angle", new_column_child="detail", cache=new_cache(spark), table="documents",
    )
    return found.df.select("doc_id", "angle", "detail")


ANGLES = {"legal": "license copyright", "privacy": "password secret", "value": "refund worthless"}


def _defined(payload, request):
    """The first label with a word of its definition in the text."""
    found = F.lit('{"value": null}')
    for label, definition in reversed(list(zip(request.labels, request.definitions))):
        hit = F.lit(False)
        for word in definition.split():
            hit = hit | F.lower(payload).contains(word)
        found = F.when(hit, F.lit(keys.canonical_json({"value": label}))).otherwise(found)
    return found


@query("assign_prompted", """
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'license|copyright') THEN 'legal' WHEN regexp_matches(lower(text), 'password|secret') THEN 'privacy'
  WHEN regexp_matches(lower(text), 'refund|worthless') THEN 'value' END AS angle,
  CASE WHEN contains(lower(text), 'password') THEN 'legal' END AS other_angle FROM documents""")
def assign_prompted(spark, sf_dir):
    """One labeler that knows the categories from its request only: other definitions, other answers."""
    labeler, cache, rows = labelers.PromptedLabeler("defined", _defined), new_cache(spark), documents(spark, sf_dir)
    for column, definitions in (("angle", ANGLES), ("other_angle", {"legal": "password"})):
        rows = taxonomy.assign_taxonomy(rows, "text", column, FLAT_GOAL, list(definitions), labeler, category_definitions=definitions,
                                        cache=cache, table="documents").df
    return rows.select("doc_id", "angle", "other_angle")


def label_prototypes(spark, sf_dir):
    """`(idx, vector)`: the mean embedding of each label."""
    mean = Summarizer.mean(array_to_vector("embedding"))
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(mean.alias("m")).select(
        F.col("label").cast("bigint").alias("idx"), vector_to_array("m").alias("vector"))


PROTOTYPES = """p AS (
  SELECT label, list(m ORDER BY pos) AS proto FROM (
    SELECT label, pos, avg(x) AS m FROM (
      SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY label, pos)
  GROUP BY label),
s AS (SELECT vec_id, e.label AS own, p.label AS idx, list_cosine_similarity(embedding::DOUBLE[], proto) AS sim FROM embeddings e, p),
b AS (SELECT vec_id, any_value(own) AS own, arg_max(idx, sim) AS best_idx, max(sim) AS best FROM s GROUP BY vec_id)"""
ROUTE_THRESHOLD = 0.75


def _routed(spark, sf_dir, mode: str):
    rows = readers.load(spark, path_of(sf_dir, "embeddings")).withColumn("note", F.concat(F.lit("label "), F.col("label").cast("string")))
    even = labelers.RuleLabeler("parity", [("[02468]$", "label_0")], "label_1")
    return taxonomy.assign_taxonomy(
        rows, "note", "topic", "topics", [f"label_{i}" for i in range(10)], even, routing_mode=mode, vector_column="embedding",
        prototypes=label_prototypes(spark, sf_dir), confidence_threshold=ROUTE_THRESHOLD,
        cache=new_cache(spark) if mode == "embed_then_llm" else None, table="embeddings",
    )


@query("route_best_prototype", f"WITH {PROTOTYPES} SELECT vec_id, best_idx::BIGINT AS best_idx, round(best, 6) AS best_similarity FROM b")
def route_best_prototype(spark, sf_dir):
    best = similarity.best_prototype(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", label_prototypes(spark, sf_dir))
    return best.select("vec_id", "best_idx", F.round("best_similarity", 6).alias("best_similarity"))


@query("route_embed_only", f"""WITH {PROTOTYPES}
SELECT vec_id, CASE WHEN best >= {ROUTE_THRESHOLD} THEN concat('label_', best_idx) END AS topic FROM b""")
def route_embed_only(spark, sf_dir):
    return _routed(spark, sf_dir, "embed_only").df.select("vec_id", "topic")


@query("route_embed_then_label", f"""WITH {PROTOTYPES}
SELECT vec_id, CASE WHEN best >= {ROUTE_THRESHOLD} THEN concat('label_', best_idx)
  WHEN own % 2 = 0 THEN 'label_0' ELSE 'label_1' END AS topic FROM b""")
def route_embed_then_label(spark, sf_dir):
    return _routed(spark, sf_dir, "embed_then_llm").df.select("vec_id", "topic")


@query("route_counters", f"""WITH {PROTOTYPES}
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE best >= {ROUTE_THRESHOLD}) AS embed_assigns,
  COUNT(*) FILTER (WHERE best < {ROUTE_THRESHOLD}) AS calls FROM b""")
def route_counters(spark, sf_dir):
    return _routed(spark, sf_dir, "embed_then_llm").counters().select("total", "embed_assigns", "calls")


@query("prototype_texts", """
SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, trim(concat(p_brand, '. ', p_type)) AS text FROM part""")
def prototype_texts(spark, sf_dir):
    """The text each category is encoded from, for a taxonomy read from a table."""
    from ..sources.row_ids import number_rows_by

    parts = number_rows_by(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), ["p_partkey"])
    return parts.select((F.col(RID) - 1).alias("idx"), taxonomy.prototype_text(F.col("p_brand"), F.col("p_type")).alias("text"))


# ---- the memo -------------------------------------------------------------------------------------------

SCHEMA_JSON = keys.canonical_json({"type": "enum", "enum": KIND_VALUES})


@query("cache_key", f"""
SELECT doc_id, sha256(concat('documents', chr(0), text, chr(0), '{KIND_PROMPT}', chr(0), '{SCHEMA_JSON}', chr(0), 'kind-rules', chr(0))) AS cache_key
FROM documents""")
def cache_key(spark, sf_dir):
    key = keys.cache_key("documents", F.col("text"), KIND_PROMPT, SCHEMA_JSON, "kind-rules")
    return read(spark, sf_dir, "documents").select("doc_id", key.alias("cache_key"))


def _filled(spark, sf_dir, cache: JudgementCache, table: str, value, where: str = "true", column: str = "kind", goal: str = "kind"):
    rows = read(spark, sf_dir, "documents").where(where).select(
        F.sha2(F.concat(F.lit(table), "text"), 256).alias("cache_key"), F.col("doc_id").alias("row_key"), value.alias("value")
    ).groupBy("cache_key").agg(F.min("row_key").alias("row_key"), F.min("value").alias("value"))
    cache.put(rows, table, column, "kind-rules", "derive_column", goal, "hash", KIND_PROMPT, "text")


@query("cache_upsert", """
SELECT sha256(concat('a', text)) AS cache_key, min(doc_id)::VARCHAR AS row_key,
  CASE WHEN any_value(n_chars) > 1000 THEN '"second"' ELSE '"first"' END AS value
FROM documents GROUP BY text""")
def cache_upsert(spark, sf_dir):
    """A later batch replaces the values of the keys it repeats."""
    cache = new_cache(spark)
    _filled(spark, sf_dir, cache, "a", F.lit('"first"'))
    _filled(spark, sf_dir, cache, "a", F.lit('"second"'), "n_chars > 1000")
    return cache.entries().select("cache_key", "row_key", "value")


@query("cache_status", """
SELECT 'a' AS table_name, 'kind' AS column_name, COUNT(DISTINCT text) AS n, 'text' AS source_columns FROM documents WHERE n_chars <= 1000
UNION ALL SELECT 'a', 'size', COUNT(DISTINCT text), 'text' FROM documents WHERE n_chars > 1000
UNION ALL SELECT 'b', 'kind', COUNT(DISTINCT text), 'text' FROM documents WHERE lang = 'en'""")
def cache_status(spark, sf_dir):
    cache = new_cache(spark)
    _filled(spark, sf_dir, cache, "a", F.lit('"x"'))
    _filled(spark, sf_dir, cache, "a", F.lit('"x"'), "n_chars > 1000", column="size")
    _filled(spark, sf_dir, cache, "b", F.lit('"x"'), "lang = 'en'")
    return cache.status().select("table_name", "column_name", "n", "source_columns")


@query("cache_invalidate", """
SELECT table_name, goal, n FROM (
SELECT 'a' AS table_name, 'kept' AS goal, COUNT(DISTINCT text) AS n FROM documents WHERE lang != 'en'
UNION ALL SELECT 'a', 'again', COUNT(DISTINCT text) FROM documents WHERE lang = 'en' AND n_chars > 1000) WHERE n > 0""")
def cache_invalidate(spark, sf_dir):
    """Deleting forgets what is there; what is judged later counts again; compaction changes nothing."""
    cache = new_cache(spark)
    _filled(spark, sf_dir, cache, "a", F.lit('"x"'), "lang != 'en'", goal="kept")
    _filled(spark, sf_dir, cache, "a", F.lit('"x"'), "lang = 'en'", goal="gone")
    cache.delete(table="a", goal="gone")
    _filled(spark, sf_dir, cache, "a", F.lit('"x"'), "lang = 'en' AND n_chars > 1000", goal="again")
    cache.compact()
    return cache.entries().groupBy("table_name", "goal").agg(F.count(F.lit(1)).alias("n"))

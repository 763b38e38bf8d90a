"""Mined taxonomies and phrases, proposals and their cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import mining
from ..sources.row_ids import RID
from .loading import documents
from .registry import query, read

# the words of each row with those that follow them, and from these all word runs
TOKENS = r"""w AS (SELECT doc_id + 1 AS rid, string_split_regex(text, '\s+') AS l FROM documents {where}),
u AS (SELECT rid, unnest(l) AS surface, unnest(range(1, len(l) + 1)) AS pos FROM w),
t AS (SELECT rid, pos, surface, lower(regexp_replace(surface, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) AS norm FROM u),
f AS (SELECT rid, norm AS n0, surface AS s0{leads} FROM t WHERE length(norm) > 0 WINDOW o AS (PARTITION BY rid ORDER BY pos)),
runs AS ({runs})"""


def _with(low: int, high: int, where: str = "") -> str:
    leads = "".join(f", lead(norm, {i}) OVER o AS n{i}, lead(surface, {i}) OVER o AS s{i}" for i in range(1, high))

    def joined(letter: str, n: int) -> str:
        return " || ' ' || ".join(f"{letter}{i}" for i in range(n))

    runs = " UNION ALL ".join(
        f"SELECT rid, {joined('n', n)} AS norm, {joined('s', n)} AS surface, {n} AS words FROM f WHERE n{n - 1} IS NOT NULL"
        for n in range(low, high + 1))
    return "WITH " + TOKENS.format(where=where, leads=leads, runs=runs) + """,
total AS (SELECT count(*) AS n FROM w),
support AS (SELECT norm AS phrase, any_value(words) AS words, count(*) AS support
  FROM (SELECT DISTINCT rid, norm, words FROM runs) GROUP BY norm)"""


EXAMPLES = """examples AS (SELECT label, string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid) AS examples FROM (
  SELECT label, rid FROM (SELECT DISTINCT label, rid FROM runs JOIN top ON norm = label)
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY rid) <= 5) GROUP BY label)"""


@query("taxonomy_candidates", _with(1, 1) + f""",
top AS (SELECT phrase AS label, support FROM support, total WHERE support <= floor(n * 0.5) AND support >= 2
  AND length(phrase) >= 4 ORDER BY support DESC, phrase LIMIT 8),
{EXAMPLES}
SELECT label, support, concat('found in ', support, ' rows') AS definition, examples FROM top JOIN examples USING (label)""")
def taxonomy_candidates(spark, sf_dir):
    found = mining.mine_taxonomy(documents(spark, sf_dir), "text", max_share=0.5, min_chars=4)
    return found.select("label", "support", "definition", F.array_join(F.col("example_rids").cast("array<string>"), ",").alias("examples"))


@query("taxonomy_hierarchical", _with(1, 3) + """,
ok AS (SELECT phrase, words, support FROM support, total WHERE support <= floor(n * 0.5) AND support >= 2),
parents AS (SELECT phrase AS word, support AS ps FROM ok WHERE words = 1 AND length(phrase) >= 4 ORDER BY support DESC, phrase LIMIT 5),
owned AS (SELECT o.phrase, o.support, word, ps FROM (SELECT DISTINCT phrase, support, unnest(string_split(phrase, ' ')) AS token FROM ok WHERE words > 1) o
  JOIN parents ON token = word QUALIFY row_number() OVER (PARTITION BY o.phrase ORDER BY ps DESC, word) = 1)
SELECT word AS parent, phrase AS label, support FROM owned
QUALIFY row_number() OVER (PARTITION BY word ORDER BY support DESC, phrase) <= 5""")
def taxonomy_hierarchical(spark, sf_dir):
    found = mining.mine_taxonomy(documents(spark, sf_dir), "text", taxonomy_shape="hierarchical", max_share=0.5, min_chars=4)
    return found.select("parent", "label", "support")


@query("issue_phrases_all", _with(2, 3) + """
SELECT phrase AS label, support FROM support WHERE support >= 2 ORDER BY support DESC, words DESC, phrase LIMIT 10""")
def issue_phrases_all(spark, sf_dir):
    return mining.mine_phrases(documents(spark, sf_dir), "text", high=3).select("label", "support")


@query("issue_phrase_variants", _with(2, 6) + """,
top AS (SELECT phrase AS label, support FROM support WHERE support >= 2 ORDER BY support DESC, words DESC, phrase LIMIT 10)
SELECT label, support, surface AS variant, count(*) AS n FROM runs JOIN top ON norm = label GROUP BY label, support, surface""")
def issue_phrase_variants(spark, sf_dir):
    """The whole table with the operator's own run lengths, and every variant."""
    return mining.mine_phrase_variants(documents(spark, sf_dir), "text")


@query("issue_phrases_closed", _with(2, 6) + """,
whole AS (SELECT DISTINCT string_split(phrase, ' ') AS l, support, words FROM support WHERE support >= 2 AND words > 2),
pieces AS (SELECT array_to_string(l[1:words - 1], ' ') AS phrase, support FROM whole UNION SELECT array_to_string(l[2:words], ' '), support FROM whole)
SELECT phrase AS label, support FROM support s WHERE support >= 2 AND NOT EXISTS (SELECT 1 FROM pieces p WHERE p.phrase = s.phrase AND p.support = s.support)
ORDER BY support DESC, words DESC, phrase LIMIT 100""")
def issue_phrases_closed(spark, sf_dir):
    """No phrase that is only a part of a longer one."""
    return mining.mine_phrases(documents(spark, sf_dir), "text", max_phrases=100, closed=True).select("label", "support")


PHRASES = _with(2, 6, "WHERE lang = 'en' AND n_chars > 100") + f""",
top AS (SELECT phrase AS label, support, words FROM support, total WHERE support <= greatest(1, floor(n * 0.5)) AND support >= 2
  ORDER BY support DESC, words DESC, phrase LIMIT 10),
{EXAMPLES},
variants AS (SELECT label, string_agg(surface, '|' ORDER BY c DESC, surface) AS variants FROM (
  SELECT label, surface, count(*) AS c FROM runs JOIN top ON norm = label GROUP BY label, surface
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, surface) <= 5) GROUP BY label)
SELECT label, support, examples, 'en' AS parent_angle, variants FROM top JOIN examples USING (label) JOIN variants USING (label)"""


def _phrases(spark, sf_dir, prune: bool):
    found = mining.mine_phrases(documents(spark, sf_dir), "text", "n_chars > 100", "lang", "en", max_share=0.5, prune=prune,
                                max_variants=fixed.EXAMPLE_ROWS)  # as many as the SQL has
    return found.select("label", "support", F.array_join(F.col("example_rids").cast("array<string>"), ",").alias("examples"),
                        "parent_angle", F.array_join("variants", "|").alias("variants"))


@query("issue_phrases", PHRASES)
def issue_phrases(spark, sf_dir):
    return _phrases(spark, sf_dir, prune=False)


@query("issue_phrases_pruned", PHRASES)
def issue_phrases_pruned(spark, sf_dir):
    """The plan used for large tables: rare runs are dropped by hash bucket before they are shuffled."""
    return _phrases(spark, sf_dir, prune=True)


@query("proposal_payload", "SELECT doc_id + 1 AS _rid, substr(text, 1, 500) AS text FROM documents")
def proposal_payload(spark, sf_dir):
    return mining.proposal_payload(documents(spark, sf_dir), "text")


@query("clean_categories", """
SELECT NULL::VARCHAR AS parent, lang AS label, concat('from ', source) AS definition FROM documents WHERE n_chars % 3 != 0""")
def clean_categories(spark, sf_dir):
    """A proposal per row: blank labels and entries that are no objects are dropped, texts trimmed."""
    label = F.when(F.col("n_chars") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "lang", F.lit(" ")))
    raw = F.concat(
        F.lit('{"categories": ['), F.to_json(F.struct(label.alias("label"), F.concat(F.lit("from "), "source").alias("definition"))),
        F.lit(', "no object", 5]}'))
    return mining.clean_categories(read(spark, sf_dir, "documents").select(raw.alias("raw")), "raw")


@query("clean_categories_hierarchical", """
SELECT lang AS parent, source AS label, '' AS definition FROM documents WHERE n_chars % 3 != 0""")
def clean_categories_hierarchical(spark, sf_dir):
    parent = F.when(F.col("n_chars") % 3 == 0, F.lit("")).otherwise(F.col("lang"))
    child = F.concat(F.lit('{"child_label": " '), F.col("source"), F.lit('"}'))
    raw = F.concat(F.lit('{"categories": [{"parent_label": "'), parent, F.lit('", "children": ['), child,
                   F.lit(', {"child_label": ""}, 3]}, {"parent_label": "x", "children": 4}, {"label": "flat"}]}'))
    return mining.clean_categories(read(spark, sf_dir, "documents").select(raw.alias("raw")), "raw", "hierarchical")


@query("clean_phrases", """
SELECT source AS label, 'd' AS definition, lang AS variants, concat(doc_id, ',', doc_id + 1) AS examples, '' AS parent_angle
FROM documents""")
def clean_phrases(spark, sf_dir):
    raw = F.concat(F.lit('{"phrases": [{"canonical_phrase": " '), "source", F.lit('", "definition": "d", "variants": ["'), "lang",
                   F.lit('"], "example_rids": ['), F.col("doc_id").cast("string"), F.lit(","), (F.col("doc_id") + 1).cast("string"),
                   F.lit(']}, {"canonical_phrase": ""}, null]}'))
    cleaned = mining.clean_phrases(read(spark, sf_dir, "documents").select(raw.alias("raw")), "raw")
    return cleaned.select("label", "definition", F.array_join("variants", "|").alias("variants"),
                          F.array_join(F.col("example_rids").cast("array<string>"), ",").alias("examples"), "parent_angle")

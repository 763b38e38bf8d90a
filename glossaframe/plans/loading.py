"""Loading, exporting, searching, filtering, previewing, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text as text_functions
from ..operators import distributions, filters, sampling
from ..scratch import new_path
from ..sources import readers, search, writers
from ..sources.row_ids import RID
from ..workspace import Workspace
from .registry import TABLES, open_tables, path_of, query, read


def documents(spark, sf_dir):
    return readers.load(spark, path_of(sf_dir, "documents"))


@query("load_with_rid", "SELECT row_number() OVER (ORDER BY doc_id) AS _rid, doc_id, lang, source, n_chars FROM documents")
def load_with_rid(spark, sf_dir):
    return documents(spark, sf_dir).select(RID, "doc_id", "lang", "source", "n_chars")


@query("load_ordered_rid", """
SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS _rid, o_orderkey, o_totalprice FROM orders""")
def load_ordered_rid(spark, sf_dir):
    loaded = readers.load(spark, path_of(sf_dir, "orders"), order_by=["o_totalprice", "o_orderkey"])
    return loaded.select(RID, "o_orderkey", "o_totalprice")


@query("load_csv_roundtrip", """
SELECT row_number() OVER (ORDER BY c_custkey) AS _rid, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def load_csv_roundtrip(spark, sf_dir):
    table = read(spark, sf_dir, "customer")
    folder = writers.export_csv(table.orderBy("c_custkey"), new_path(spark, "customer-csv"))
    return readers.load(spark, folder, fmt=".csv", schema=table.schema, multiline=False)


@query("load_json_roundtrip", """
SELECT row_number() OVER (ORDER BY p_partkey) AS _rid, p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part""")
def load_json_roundtrip(spark, sf_dir):
    table = read(spark, sf_dir, "part")
    folder = new_path(spark, "part-json")
    table.orderBy("p_partkey").write.json(folder)
    return readers.load(spark, folder, fmt=".jsonl", schema=table.schema)


@query("export_csv", """
SELECT o_custkey, COUNT(*) AS n_orders, max(o_orderpriority) AS top_priority FROM orders GROUP BY o_custkey""")
def export_csv(spark, sf_dir):
    open_tables(spark, sf_dir)
    folder = Workspace(spark).export_table(
        "SELECT o_custkey, COUNT(*) AS n_orders, max(o_orderpriority) AS top_priority FROM orders GROUP BY o_custkey;",
        new_path(spark, "orders-export"),
    )
    return readers.read_file(spark, folder, "o_custkey bigint, n_orders bigint, top_priority string", ".csv", multiline=False)


@query("catalog_describe", " UNION ALL ".join(f"SELECT '{t}' AS name, COUNT(*) AS n_rows FROM {t}" for t in TABLES))
def catalog_describe(spark, sf_dir):
    workspace = Workspace(spark)
    for table in TABLES:
        workspace.register(table, read(spark, sf_dir, table), path_of(sf_dir, table))
    return workspace.describe().select("name", "n_rows")


BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def lines_sql(column: str) -> str:
    return f"string_split_regex(regexp_replace({column}, '(?:{BREAK})\\z', ''), '{BREAK}')"


MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("corpus_grep", rf"""
SELECT doc_id, line_no, regexp_replace(line, '\s+$', '') AS line FROM (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no
  FROM (SELECT doc_id, {lines_sql('text')} AS l FROM documents WHERE length(text) > 0)
) WHERE regexp_matches(line, '{MAIL}')""")
def corpus_grep(spark, sf_dir):
    return search.grep(read(spark, sf_dir, "documents"), MAIL, "doc_id", "text")


@query("corpus_grep_top", rf"""
SELECT page_id, line_no, regexp_replace(line, '\s+$', '') AS line FROM (
  SELECT page_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no
  FROM (SELECT page_id, {lines_sql('html')} AS l FROM pages WHERE length(html) > 0)
) WHERE regexp_matches(line, '<h[1-6]') ORDER BY page_id, line_no LIMIT {fixed.SEARCH_MATCHES}""")
def corpus_grep_top(spark, sf_dir):
    return search.grep(read(spark, sf_dir, "pages"), "<h[1-6]", "page_id", "html", fixed.SEARCH_MATCHES)


FILE_DOCS = 1000


@query("corpus_grep_files", rf"""
SELECT part, line_no, regexp_replace(line, '\s+$', '') AS line FROM (
  SELECT part, line, row_number() OVER (PARTITION BY part ORDER BY doc_id, i) AS line_no
  FROM (SELECT doc_id, doc_id // {FILE_DOCS} AS part, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, {lines_sql("(coalesce(text, '') || chr(10))")} AS l FROM documents))
) WHERE regexp_matches(line, '{MAIL}')""")
def corpus_grep_files(spark, sf_dir):
    """Texts in files of FILE_DOCS documents, searched by line of a file."""
    folder = new_path(spark, "text-files")
    part = F.floor(F.col("doc_id") / FILE_DOCS).alias("part")
    texts = read(spark, sf_dir, "documents").select(part, "doc_id", "text")
    texts.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "text").write.partitionBy("part").text(folder)
    found = search.grep_files(spark, folder, MAIL)
    return found.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint").alias("part"), "line_no", "line")


@query("load_csv_dialects", """
SELECT row_number() OVER (PARTITION BY sep ORDER BY c_custkey) AS _rid, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, sep
FROM customer, (VALUES (';'), ('|')) AS s(sep)""")
def load_csv_dialects(spark, sf_dir):
    """Files of two dialects, loaded without saying which."""
    table = read(spark, sf_dir, "customer")
    loaded = []
    for sep in (";", "|"):
        folder = new_path(spark, "customer-dialect")
        table.orderBy("c_custkey").write.option("header", True).option("sep", sep).csv(folder)
        loaded.append(readers.load(spark, folder, fmt=".csv", schema=table.schema, multiline=False).withColumn("sep", F.lit(sep)))
    return loaded[0].unionByName(loaded[1])


@query("subset_drilldown", """
SELECT row_number() OVER (ORDER BY o_orderkey) AS _rid, o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders
QUALIFY o_totalprice > 50000 AND o_orderpriority IS NOT NULL AND o_orderstatus = 'F'""")
def subset_drilldown(spark, sf_dir):
    orders = readers.load(spark, path_of(sf_dir, "orders"))
    focused = filters.drill_down(orders, "o_totalprice > 50000 AND o_orderpriority IS NOT NULL", "o_orderstatus", "F")
    return filters.subset(focused, columns=["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"])


@query("pick_rows", """
SELECT rid AS _rid, doc_id, lang FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, lang FROM documents)
WHERE rid IN (SELECT doc_id + 1 FROM labels WHERE toxic = 1)""")
def pick_rows(spark, sf_dir):
    ids = read(spark, sf_dir, "labels").where("toxic = 1").select((F.col("doc_id") + 1).alias(RID))
    return filters.pick_rows(documents(spark, sf_dir), ids).select(RID, "doc_id", "lang")


@query("preview", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(lang AS VARCHAR) AS lang,
       CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 197), '...') ELSE text END AS text
FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 50)""")
def preview(spark, sf_dir):
    return filters.preview(read(spark, sf_dir, "documents").orderBy("doc_id").select("doc_id", "lang", "text"))


@query("infer_polarity", f"""
SELECT doc_id,
  CASE WHEN regexp_matches(lower(text), '{"|".join(fixed.NEGATIVE_WORDS)}') THEN 'negative'
       WHEN regexp_matches(lower(text), '{"|".join(fixed.POSITIVE_WORDS)}') THEN 'positive' END AS polarity,
  CASE WHEN regexp_matches(lower(text), '{"|".join(fixed.NEGATIVE_PHRASE_WORDS)}') THEN 'negative'
       WHEN regexp_matches(lower(text), '{"|".join(fixed.POSITIVE_WORDS)}') THEN 'positive' END AS phrase_polarity,
  CASE WHEN regexp_matches(lower(text), '(?:^|[^\\p{{L}}\\p{{N}}_])(?:{"|".join(fixed.NEGATIVE_WORDS)})(?:[^\\p{{L}}\\p{{N}}_]|$)') THEN 'negative'
       WHEN regexp_matches(lower(text), '(?:^|[^\\p{{L}}\\p{{N}}_])(?:{"|".join(fixed.POSITIVE_WORDS)})(?:[^\\p{{L}}\\p{{N}}_]|$)') THEN 'positive' END AS word_polarity
FROM documents""")
def infer_polarity(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id", text_functions.infer_polarity(text).alias("polarity"),
        text_functions.infer_polarity(text, phrases=True).alias("phrase_polarity"),
        text_functions.infer_polarity(text, whole_words=True).alias("word_polarity"),
    )


@query("text_functions", r"""
SELECT d.doc_id, trim(lang) AS lang, lower(substr(text, 1, 160)) AS lower_160, substr(replace(text, chr(10), ' '), 1, 100) AS flat_100,
  CASE WHEN length(replace(text, chr(10), ' ')) > 100 THEN concat(substr(replace(text, chr(10), ' '), 1, 97), '...')
       ELSE replace(text, chr(10), ' ') END AS cut_100,
  sha256(text) AS text_sha, len(regexp_extract_all(text, '[0-9]+')) AS n_numbers,
  concat('{"lang":"', lang, '","n_chars":', n_chars, '}') AS as_json,
  coalesce(l.quality, -1) AS quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def text_functions_query(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    return read(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        "doc_id", F.trim("lang").alias("lang"), F.lower(F.substring("text", 1, 160)).alias("lower_160"),
        F.substring(text_functions.single_line(F.col("text")), 1, 100).alias("flat_100"),
        filters.flat_text("text").alias("cut_100"), F.sha2("text", 256).alias("text_sha"),
        F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).cast("bigint").alias("n_numbers"),
        F.to_json(F.struct("lang", "n_chars")).alias("as_json"), F.coalesce("quality", F.lit(-1)).alias("quality"),
    )


@query("json_values", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_values(spark, sf_dir):
    parsed = F.from_json("props", "k bigint")
    return read(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))


@query("label_distribution", """
SELECT coalesce(CAST(quality AS VARCHAR), 'NULL') AS label, COUNT(*) AS n
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def label_distribution(spark, sf_dir):
    joined = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return distributions.label_distribution(joined, "quality")


@query("hier_rollup", """
SELECT lang AS parent, source AS child, COUNT(*) AS n, CAST(GROUPING(lang) + GROUPING(source) AS INTEGER) AS level
FROM documents GROUP BY ROLLUP (lang, source)""")
def hier_rollup(spark, sf_dir):
    return distributions.parent_child_distribution(read(spark, sf_dir, "documents"), "lang", "source")


@query("topic_shares", """
SELECT label, COUNT(*) AS n, round(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 4) AS pct FROM embeddings GROUP BY label""")
def topic_shares(spark, sf_dir):
    return distributions.topic_shares(read(spark, sf_dir, "embeddings"), "label")


# ---- samples --------------------------------------------------------------------------------------------

RIDS = "(SELECT row_number() OVER (ORDER BY doc_id) AS _rid, * FROM documents)"


@query("sample_random", f"""
SELECT _rid, doc_id, lang FROM {RIDS} WHERE n_chars > 200 ORDER BY md5(concat(CAST(_rid AS VARCHAR), '7')) LIMIT 100""")
def sample_random(spark, sf_dir):
    return sampling.sample_rows(documents(spark, sf_dir), 100, where="n_chars > 200", seed=7).select(RID, "doc_id", "lang")


@query("sample_strat_quota", f"""
SELECT _rid, doc_id, source FROM {RIDS}
QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(concat(CAST(_rid AS VARCHAR), '7'))) <= 5""")
def sample_strat_quota(spark, sf_dir):
    sample = sampling.sample_rows(documents(spark, sf_dir), 5, method="stratified", stratify_by="source", seed=7)
    return sample.select(RID, "doc_id", "source")


@query("sample_strat_ordered", f"""
SELECT _rid, doc_id, lang FROM {RIDS} ORDER BY lang, md5(concat(CAST(_rid AS VARCHAR), '7')) LIMIT 150""")
def sample_strat_ordered(spark, sf_dir):
    sample = sampling.sample_rows(documents(spark, sf_dir), 150, method="stratified", stratify_by="lang", seed=7,
                                  stratified_mode="ordered")
    return sample.select(RID, "doc_id", "lang")

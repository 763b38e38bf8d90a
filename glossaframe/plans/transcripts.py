"""Conversation transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import transcripts
from .loading import lines_sql
from .registry import query, read

LONG_CHARS, LONG_LINES = 600, 4
LINES = lines_sql("text")


def snipped_sql(chars: int, lines: int) -> str:
    return f"""CASE WHEN length(text) > {chars} AND len({LINES}) > {lines} THEN concat(
  array_to_string(({LINES})[1:3], chr(10)), chr(10), '... (', len({LINES}), ' lines, snipped to save context) ...', chr(10),
  array_to_string(({LINES})[-3:], chr(10))) ELSE text END"""


def conversations(spark, sf_dir):
    return read(spark, sf_dir, "conversations")


@query("token_estimate", """
SELECT conv_id, count(*) AS n_messages, CAST(sum(length(text) // 3) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id""")
def token_estimate(spark, sf_dir):
    return transcripts.token_estimate(conversations(spark, sf_dir))


@query("snip_turns", f"""
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN {snipped_sql(LONG_CHARS, LONG_LINES)} ELSE text END AS text
FROM conversations""")
def snip_turns(spark, sf_dir):
    snipped = transcripts.snip_turns(conversations(spark, sf_dir), "assistant", LONG_CHARS, LONG_LINES)
    return snipped.select("conv_id", "turn", "text")


@query("snip_turns_default", f"""
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN {snipped_sql(1500, 6)} ELSE text END AS text FROM conversations""")
def snip_turns_default(spark, sf_dir):
    return transcripts.snip_turns(conversations(spark, sf_dir), "assistant").select("conv_id", "turn", "text")


DIGEST = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, substr(string_agg(concat('[', role, '] ', substr(text, 1, 400)), chr(10) ORDER BY turn), 1, {chars}) AS digest
FROM r WHERE back > {keep} AND length(text) > 0 GROUP BY conv_id"""


@query("keep_recent_digest", DIGEST.format(keep=4, chars=15000))
def keep_recent_digest(spark, sf_dir):
    return transcripts.keep_recent_digest(conversations(spark, sf_dir), 4)


@query("keep_recent_digest_short", DIGEST.format(keep=2, chars=300))
def keep_recent_digest_short(spark, sf_dir):
    return transcripts.keep_recent_digest(conversations(spark, sf_dir), 2, chars=300)


@query("mark_recent", """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3 AS is_recent FROM conversations""")
def mark_recent(spark, sf_dir):
    return transcripts.mark_recent(conversations(spark, sf_dir), 3).select("conv_id", "turn", "is_recent")


def key_info_sql(source: str) -> str:
    return rf"""
base AS ({source}),
paths AS (SELECT conv_id, string_agg(item, ', ' ORDER BY item) AS p FROM (
  SELECT conv_id, item FROM (SELECT DISTINCT conv_id, item FROM (
    SELECT conv_id, unnest(regexp_extract_all(text, '{fixed.PATH_PATTERN}')) AS item FROM base))
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY item) <= 20) GROUP BY conv_id),
found AS (SELECT conv_id, turn, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT conv_id, turn, {LINES} AS l FROM base)),
errors AS (SELECT conv_id, string_agg(item, '; ' ORDER BY turn, pos) AS e FROM (
  SELECT conv_id, turn, pos, substr(regexp_replace(line, '^\s+|\s+$', '', 'g'), 1, 150) AS item FROM found
  WHERE contains(lower(line), 'error') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) <= 5) GROUP BY conv_id),
info AS (SELECT c.conv_id, CASE WHEN p IS NULL AND e IS NULL THEN '{fixed.NO_KEY_INFO}'
  ELSE concat_ws(chr(10), '{fixed.PATHS_HEADING}' || p, '{fixed.ERRORS_HEADING}' || e) END AS info
  FROM (SELECT DISTINCT conv_id FROM base) c LEFT JOIN paths USING (conv_id) LEFT JOIN errors USING (conv_id))"""


@query("key_info", "WITH " + key_info_sql("SELECT conv_id, turn, text FROM conversations") + " SELECT conv_id, info FROM info")
def key_info(spark, sf_dir):
    return transcripts.key_info(conversations(spark, sf_dir))


@query("key_info_of_documents", "WITH " + key_info_sql("SELECT lang AS conv_id, doc_id AS turn, text FROM documents") + " SELECT conv_id, info FROM info")
def key_info_of_documents(spark, sf_dir):
    """Documents read as four very long conversations, one per language."""
    rows = read(spark, sf_dir, "documents").select(F.col("lang").alias("conv_id"), F.col("doc_id").alias("turn"), "text")
    return transcripts.key_info(rows)


BUDGET = 1500
PLAN = f"""
WITH s AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN {snipped_sql(1500, 6)} ELSE text END AS short FROM conversations),
f AS (SELECT conv_id, count(*) AS n_messages, CAST(sum(length(text) // 3) AS BIGINT) AS tokens,
  CAST(sum(length(short) // 3) AS BIGINT) AS short_tokens, bool_or(text <> short) AS changes FROM s GROUP BY conv_id),
g AS (SELECT *, tokens > {BUDGET * 50 // 100} AND changes AS snips, CASE WHEN tokens > {BUDGET * 50 // 100} AND changes THEN short_tokens ELSE tokens END AS tokens_after_snip FROM f),
h AS (SELECT *, tokens_after_snip > {BUDGET * 70 // 100} AND n_messages > 4 AS summarizes FROM g),
m AS (SELECT s.conv_id, turn, role, CASE WHEN snips THEN short ELSE text END AS text,
  row_number() OVER (PARTITION BY s.conv_id ORDER BY turn DESC) AS back FROM s JOIN h USING (conv_id) WHERE summarizes),
{key_info_sql("SELECT conv_id, turn, text FROM m WHERE back > 3")},
t AS (SELECT conv_id, CAST(sum(length(text) // 3) AS BIGINT) AS kept FROM m WHERE back <= 3 GROUP BY conv_id),
a AS (SELECT h.*, CASE WHEN summarizes THEN kept + length(concat('{fixed.SUMMARY_HEADING.strip()}', chr(10), info)) // 3
  + length('{fixed.SUMMARY_REPLY}') // 3 ELSE tokens_after_snip END AS tokens_after_summary
  FROM h LEFT JOIN t USING (conv_id) LEFT JOIN info USING (conv_id))
SELECT conv_id, n_messages, tokens, snips, tokens_after_snip, summarizes, CAST(tokens_after_summary AS BIGINT) AS tokens_after_summary,
  tokens_after_summary > {BUDGET * 90 // 100} AND CASE WHEN summarizes THEN 5 ELSE n_messages END > 3 AS collapses FROM a"""
STEPS = dict(max_tokens=BUDGET, role="assistant", summary_over=4, summary_keep=3, collapse_over=3, collapse_keep=2)


@query("compaction_plan", PLAN)
def compaction_plan(spark, sf_dir):
    """With limits low enough for the short conversations of the test tables."""
    plan = transcripts.compaction_plan(conversations(spark, sf_dir), **STEPS)
    return plan.select("conv_id", "n_messages", "tokens", "snips", "tokens_after_snip", "summarizes", "tokens_after_summary", "collapses")


@query("compact_sizes", f"""
SELECT conv_id, CASE WHEN collapses THEN 4 WHEN summarizes THEN 5 ELSE n_messages END AS n_messages FROM ({PLAN})""")
def compact_sizes(spark, sf_dir):
    compacted = transcripts.compact(conversations(spark, sf_dir), **STEPS)
    return compacted.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"))


@query("conversation_list", """
SELECT conv_id, coalesce((SELECT substr(text, 1, 80) FROM conversations u
  WHERE u.conv_id = c.conv_id AND role = 'user' AND length(text) > 0 ORDER BY turn LIMIT 1), '') AS preview
FROM (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id DESC LIMIT 20) c""")
def conversation_list(spark, sf_dir):
    return transcripts.conversation_list(conversations(spark, sf_dir), fixed.LISTING_ROWS)


@query("cost_estimate", """
WITH u AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'unknown' END AS model,
  sum(CASE WHEN role <> 'assistant' THEN length(text) // 3 ELSE 0 END) AS i, sum(CASE WHEN role = 'assistant' THEN length(text) // 3 ELSE 0 END) AS o
  FROM conversations GROUP BY conv_id)
SELECT conv_id, model, round(CASE model WHEN 'small' THEN i * 0.5 + o * 1.5 WHEN 'large' THEN i * 2.5 + o * 15.0 END / 1000.0, 6) AS cost_thousandths FROM u""")
def cost_estimate(spark, sf_dir):
    size = transcripts.tokens(F.col("text"))
    model = F.when(F.col("conv_id") % 3 == 0, "small").when(F.col("conv_id") % 3 == 1, "large").otherwise("unknown")
    said = F.col("role") == "assistant"
    usage = conversations(spark, sf_dir).groupBy("conv_id", model.alias("model")).agg(
        F.sum(F.when(~said, size).otherwise(0)).alias("prompt_tokens"), F.sum(F.when(said, size).otherwise(0)).alias("completion_tokens"))
    prices = spark.createDataFrame([("small", 0.5, 1.5), ("large", 2.5, 15.0)], "model string, input_price double, output_price double")
    return transcripts.cost_estimate(usage, prices).select("conv_id", "model", F.round(F.col("cost") * 1000, 6).alias("cost_thousandths"))

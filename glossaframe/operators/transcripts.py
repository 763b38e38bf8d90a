"""Conversation transcripts `(conv_id, turn, role, text)`: size, compaction, digests, listing, cost.

A conversation may be of any length: per-conversation work is an aggregation that combines map-side, or a
bounded list cut out by `top_n_per_group`. No conversation is ever gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, values
from ..functions.text import explode_values, lines, number_lines, text_or_empty
from ..scratch import stage
from .labelers import Request
from .skew import hot_keys, join_skewed, top_n_per_group

CONV, TURN = "conv_id", "turn"
# The shortest line of a digest is "[] x" and its line break, so this many lines fill any digest.
MIN_DIGEST_LINE = 5


def tokens(text: Column) -> Column:
    return F.floor(F.length(text_or_empty(text)) / fixed.CHARS_PER_TOKEN).cast("bigint")


def token_estimate(messages: DataFrame) -> DataFrame:
    """`(conv_id, n_messages, tokens)`: a third of the characters of each message, rounded down, summed."""
    return messages.groupBy(CONV).agg(F.count(F.lit(1)).alias("n_messages"), F.sum(tokens(F.col("text"))).alias("tokens"))


def snip(text: Column, min_chars: int = fixed.SNIP_MIN_CHARS, max_lines: int = fixed.SNIP_MAX_LINES,
         edge: int = fixed.SNIP_EDGE_LINES) -> Column:
    """The first and last lines of a long text of many lines, with a marker for what was between."""
    parts = lines(text)
    n = F.size(parts)
    short = F.concat(
        F.array_join(F.slice(parts, 1, edge), "\n"), F.lit(fixed.SNIP_MARKER_BEFORE), n.cast("string"),
        F.lit(fixed.SNIP_MARKER_AFTER), F.array_join(F.slice(parts, -edge, edge), "\n"),
    )
    return F.when((F.length(text) > min_chars) & (n > max_lines), short).otherwise(text)


def snip_turns(messages: DataFrame, role: str = "tool", min_chars: int = fixed.SNIP_MIN_CHARS,
               max_lines: int = fixed.SNIP_MAX_LINES) -> DataFrame:
    """Snip the texts of one role. A narrow pass; all other columns stay."""
    text = F.when(F.col("role") == role, snip(F.col("text"), min_chars, max_lines)).otherwise(F.col("text"))
    return messages.withColumn("text", text)


def _attach(messages: DataFrame, per_conversation: DataFrame) -> DataFrame:
    """Join one row per conversation to its messages; messages of huge conversations are spread over tasks."""
    sizes = messages.groupBy(CONV).agg(F.count(F.lit(1)).alias("n_rows"))
    return join_skewed(messages, per_conversation, CONV, hot_keys(sizes, CONV), F.col(TURN), "inner")


def recent_from(messages: DataFrame, keep: int) -> DataFrame:
    """`(conv_id, cut)`: the turn from which the last `keep` messages start."""
    last = top_n_per_group(messages.select(CONV, TURN), [CONV], [F.desc(TURN)], keep, F.col(TURN))
    return last.groupBy(CONV).agg(F.min(TURN).alias("cut"))


def mark_recent(messages: DataFrame, keep: int = fixed.SUMMARY_KEEP) -> DataFrame:
    """Add `cut` and `is_recent`: whether a message is among the last `keep` of its conversation."""
    return _attach(messages, recent_from(messages, keep)).withColumn("is_recent", F.col(TURN) >= F.col("cut"))


def digest(messages: DataFrame, turn_chars: int = fixed.DIGEST_TURN_CHARS, chars: int = fixed.DIGEST_CHARS) -> DataFrame:
    """`(conv_id, digest)`: one line per non-empty message, `[role] start of text`, in order, cut to `chars`."""
    line = F.concat(F.lit("["), F.coalesce("role", F.lit("?")), F.lit("] "), F.substring("text", 1, turn_chars))
    kept = messages.where(F.length("text") > 0).select(CONV, TURN, line.alias("line"))
    enough = top_n_per_group(kept, [CONV], [F.col(TURN)], -(-chars // MIN_DIGEST_LINE), F.col(TURN))
    ordered = F.array_sort(F.collect_list(F.struct(TURN, "line")))
    joined = F.array_join(F.transform(ordered, lambda s: s["line"]), "\n")
    return enough.groupBy(CONV).agg(F.substring(joined, 1, chars).alias("digest"))


def keep_recent_digest(messages: DataFrame, keep: int = fixed.SUMMARY_KEEP, turn_chars: int = fixed.DIGEST_TURN_CHARS,
                       chars: int = fixed.DIGEST_CHARS) -> DataFrame:
    """`(conv_id, digest)` of the messages before the last `keep`."""
    return digest(mark_recent(messages, keep).where(~F.col("is_recent")), turn_chars, chars)


def key_info(messages: DataFrame) -> DataFrame:
    """`(conv_id, info)`: the first 20 distinct path-like words in order, and the first 5 lines with an error."""
    text = text_or_empty(F.col("text"))
    found = explode_values(messages, [CONV], F.array_distinct(F.regexp_extract_all(text, F.lit(fixed.PATH_PATTERN), 0)), "item")
    paths = top_n_per_group(found.distinct(), [CONV], [F.col("item")], fixed.KEY_PATHS, F.col("item"))
    wrong = (
        number_lines(messages.where(F.lower(text).contains("error")), [CONV, TURN], text)
        .where(F.lower("line").contains("error"))
        .select(CONV, TURN, "pos", F.substring(F.regexp_replace("line", r"^\s+|\s+$", ""), 1, fixed.KEY_ERROR_CHARS).alias("item"))
    )
    errors = top_n_per_group(wrong, [CONV], [F.col(TURN), F.col("pos")], fixed.KEY_ERRORS, F.struct(TURN, "pos"))
    kind = lambda name: F.lit(name).alias("kind")
    items = (
        paths.select(CONV, kind("path"), "rank", "item")
        .unionByName(errors.select(CONV, kind("error"), "rank", "item"))
        .unionByName(messages.select(CONV, kind("none"), F.lit(0).alias("rank"), F.lit("").alias("item")).dropDuplicates([CONV]))
    )

    def listed(name: str, separator: str) -> Column:
        mine = F.array_sort(F.collect_list(F.when(F.col("kind") == name, F.struct("rank", "item"))))
        return F.array_join(F.transform(mine, lambda s: s["item"]), separator)

    grouped = items.groupBy(CONV).agg(listed("path", ", ").alias("p"), listed("error", "; ").alias("e"))
    info = F.concat_ws(
        "\n", F.when(F.col("p") != "", F.concat(F.lit(fixed.PATHS_HEADING), "p")),
        F.when(F.col("e") != "", F.concat(F.lit(fixed.ERRORS_HEADING), "e")),
    )
    return grouped.select(CONV, F.when(info == "", F.lit(fixed.NO_KEY_INFO)).otherwise(info).alias("info"))


def _summaries(old: DataFrame, summarizer) -> DataFrame:
    """`(conv_id, summary)`: by the labeler from the digest, else the key facts."""
    facts = key_info(old)
    if summarizer is None:
        return facts.withColumnRenamed("info", "summary")
    answered = stage(summarizer.label(digest(old), "digest", "raw", Request("Summarize this conversation.")), "summaries")
    said = answered.select(CONV, values.typed_value(values.answer_value_json(F.col("raw")), "string").alias("said"))
    return facts.join(said, CONV, "left").select(CONV, F.coalesce("said", "info").alias("summary"))


def _replace_old(messages: DataFrame, keep: int, heading: str, reply: str, summarizer) -> DataFrame:
    """Put a summary and a reply in the place of all but the last `keep` messages."""
    marked = stage(mark_recent(messages.select(CONV, TURN, "role", "text"), keep), "marked-turns")
    old = marked.where(~F.col("is_recent")).select(CONV, TURN, "role", "text")
    cuts = marked.groupBy(CONV).agg(F.first("cut").alias("cut"))
    head = _summaries(old, summarizer).join(cuts, CONV)
    pair = F.explode(F.array(
        F.struct((F.col("cut") - 2).alias(TURN), F.lit("user").alias("role"), F.concat(F.lit(heading), "summary").alias("text")),
        F.struct((F.col("cut") - 1).alias(TURN), F.lit("assistant").alias("role"), F.lit(reply).alias("text")),
    )).alias("m")
    return head.select(CONV, pair).select(CONV, "m.*").unionByName(marked.where("is_recent").select(CONV, TURN, "role", "text"))


def _plan(messages: DataFrame, max_tokens: int, role: str, summarizer, summary_over: int, summary_keep: int,
          collapse_over: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The messages after the first step, the summarized conversations, and the steps of each conversation."""
    snip_at, summary_at, collapse_at = (
        int(max_tokens * share) for share in (fixed.SNIP_SHARE, fixed.SUMMARY_SHARE, fixed.COLLAPSE_SHARE)
    )
    both = messages.select(CONV, TURN, "role", text_or_empty(F.col("text")).alias("text")).withColumn(
        "__snipped", F.when(F.col("role") == role, snip(F.col("text"))).otherwise(F.col("text"))
    )
    sums = both.groupBy(CONV).agg(
        F.count(F.lit(1)).alias("n_messages"), F.sum(tokens(F.col("text"))).alias("tokens"),
        F.sum(tokens(F.col("__snipped"))).alias("__snipped_tokens"),
        F.max(F.col("text") != F.col("__snipped")).alias("__changes"),
    )
    first = sums.withColumn("snips", (F.col("tokens") > snip_at) & F.col("__changes"))
    first = first.withColumn("tokens_after_snip", F.when(F.col("snips"), F.col("__snipped_tokens")).otherwise(F.col("tokens")))
    first = first.withColumn("summarizes", (F.col("tokens_after_snip") > summary_at) & (F.col("n_messages") > summary_over))
    first = stage(first.drop("__snipped_tokens", "__changes"), "compaction-sizes")

    snipped = _attach(both, first.select(CONV, "snips", "summarizes")).withColumn(
        "text", F.when(F.col("snips"), F.col("__snipped")).otherwise(F.col("text"))
    )
    summarized = stage(
        _replace_old(snipped.where("summarizes"), summary_keep, fixed.SUMMARY_HEADING, fixed.SUMMARY_REPLY, summarizer),
        "summarized-turns",
    )
    after = token_estimate(summarized).withColumnsRenamed({"n_messages": "__n", "tokens": "__tokens"})
    plan = first.join(after, CONV, "left").withColumn("tokens_after_summary", F.coalesce("__tokens", "tokens_after_snip"))
    many = F.coalesce("__n", "n_messages") > collapse_over
    plan = stage(plan.withColumn("collapses", (F.col("tokens_after_summary") > collapse_at) & many).drop("__n", "__tokens"), "compaction-plan")
    return snipped, summarized, plan


def _collapsed(snipped: DataFrame, summarized: DataFrame, plan: DataFrame, collapse_keep: int, summarizer) -> DataFrame:
    shape = [CONV, TURN, "role", "text"]
    flags = plan.select(CONV, "collapses")
    untouched = _attach(snipped.where(~F.col("summarizes")).select(*shape), flags)
    shortened = _attach(summarized, flags)
    current = untouched.unionByName(shortened)
    collapsed = _replace_old(current.where("collapses"), collapse_keep, fixed.COLLAPSE_HEADING, fixed.COLLAPSE_REPLY, summarizer)
    return current.where(~F.col("collapses")).select(*shape).unionByName(collapsed)


def compact(messages: DataFrame, max_tokens: int = 128_000, role: str = "tool", summarizer=None,
            summary_over: int = fixed.SUMMARY_OVER_MESSAGES, summary_keep: int = fixed.SUMMARY_KEEP,
            collapse_over: int = fixed.COLLAPSE_OVER_MESSAGES, collapse_keep: int = fixed.COLLAPSE_KEEP) -> DataFrame:
    """Transcripts brought down towards a token budget in up to three steps, each only if the size after the
    one before still calls for it: snip long texts of `role`, summarize all but the last messages, collapse.
    A summary and its reply take the two turn numbers before the first message kept."""
    steps = _plan(messages, max_tokens, role, summarizer, summary_over, summary_keep, collapse_over)
    return _collapsed(*steps, collapse_keep, summarizer)


def compaction_plan(messages: DataFrame, max_tokens: int = 128_000, role: str = "tool", summarizer=None,
                    summary_over: int = fixed.SUMMARY_OVER_MESSAGES, summary_keep: int = fixed.SUMMARY_KEEP,
                    collapse_over: int = fixed.COLLAPSE_OVER_MESSAGES, collapse_keep: int = fixed.COLLAPSE_KEEP) -> DataFrame:
    """Per conversation: messages, tokens, which steps `compact` takes, and the tokens after each. `collapse_keep` is
    taken so that both accept the same settings; it changes no step."""
    return _plan(messages, max_tokens, role, summarizer, summary_over, summary_keep, collapse_over)[2]


def conversation_list(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """`(conv_id, preview)`: conversations from the highest id down, each with the start of its first user message.

    All of them, or the first `limit`."""
    ids = messages.select(CONV).distinct()
    if limit is not None:
        # at most `limit` ids: the previews are built for these conversations only
        ids = ids.orderBy(F.desc(CONV)).limit(limit)
    spoken = (F.col("role") == "user") & (F.length("text") > 0)
    opening = F.min(F.when(spoken, F.struct(TURN, F.substring("text", 1, fixed.LISTING_PREVIEW_CHARS).alias("preview"))))
    out = messages.join(ids, CONV, "left_semi").groupBy(CONV).agg(F.coalesce(opening["preview"], F.lit("")).alias("preview"))
    return out.orderBy(F.desc(CONV))


def cost_estimate(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Add `cost` to `(model, prompt_tokens, completion_tokens)` from `(model, input_price, output_price)` per
    million tokens; null for a model without a price."""
    million = F.lit(1_000_000.0)
    cost = F.col("prompt_tokens") * F.col("input_price") / million + F.col("completion_tokens") * F.col("output_price") / million
    return usage.join(prices, "model", "left").withColumn("cost", cost).drop("input_price", "output_price")

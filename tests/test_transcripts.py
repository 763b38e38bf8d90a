"""Transcripts against plain Python."""

import pytest
from pyspark.sql import functions as F

from glossaframe.functions import fixed
from glossaframe.operators import labelers, skew, transcripts

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def size(rows):
    return sum(len(t or "") // 3 for _, _, _, t in rows)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def collected(df):
    return sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect())


def test_token_estimate(spark):
    df = frame(spark, [(1, 0, "user", "hello world"), (1, 1, "assistant", None), (2, 0, "user", "ab")])
    assert {r["conv_id"]: (r["n_messages"], r["tokens"]) for r in transcripts.token_estimate(df).collect()} == {1: (2, 3), 2: (1, 0)}


def test_snip_keeps_both_ends(spark):
    long = "x\n" * 1000
    df = frame(spark, [(1, 0, "tool", long), (1, 1, "user", long), (1, 2, "tool", "y" * 2000), (1, 3, "tool", "short")])
    texts = {t: x for _, t, _, x in collected(transcripts.snip_turns(df))}
    assert texts[0] == "x\nx\nx\n... (1000 lines, snipped to save context) ...\nx\nx\nx"
    assert texts[1] == long and texts[2] == "y" * 2000 and texts[3] == "short"


def conversation(conv, turns):
    rows = []
    for i in range(turns):
        rows.append((conv, 2 * i, "user", f"step {i}: " + "please look again " * 12))
        rows.append((conv, 2 * i + 1, "tool", "one more value; " * 125))
    return rows


def test_compaction_of_a_long_conversation(spark):
    rows = conversation(1, 20) + [(2, 0, "user", "short"), (2, 1, "assistant", "answer")]
    compacted = collected(transcripts.compact(frame(spark, rows), max_tokens=2000))
    first = [r for r in compacted if r[0] == 1]
    # summary of 8 kept messages is still too large, so it collapses to the last 4
    assert len(first) == 6 and size(first) < size([r for r in rows if r[0] == 1])
    assert first[0][2:] == ("user", fixed.COLLAPSE_HEADING + fixed.NO_KEY_INFO)
    assert first[1][2:] == ("assistant", fixed.COLLAPSE_REPLY)
    assert [r[1] for r in first[2:]] == [36, 37, 38, 39]
    assert [r for r in compacted if r[0] == 2] == rows[-2:]
    plan = {r["conv_id"]: r for r in transcripts.compaction_plan(frame(spark, rows), max_tokens=2000).collect()}
    assert (plan[1]["snips"], plan[1]["summarizes"], plan[1]["collapses"]) == (False, True, True)
    assert plan[1]["tokens"] == size([r for r in rows if r[0] == 1])
    assert (plan[2]["snips"], plan[2]["summarizes"], plan[2]["collapses"]) == (False, False, False)


def test_size_is_taken_again_after_each_step(spark):
    rows = [(1, i, "tool", "line of text\n" * 200) for i in range(12)]
    plan = transcripts.compaction_plan(frame(spark, rows), max_tokens=10_000).first()
    assert plan["snips"] and plan["tokens"] == 12 * (2600 // 3)
    assert not plan["summarizes"] and not plan["collapses"]
    assert all("200 lines" in r[3] for r in collected(transcripts.compact(frame(spark, rows), max_tokens=10_000)))


def test_summary_by_labeler_or_by_key_facts(spark):
    rows = [(1, i, "user", f"see src/file{i}.py and an Error here" + "z" * 300) for i in range(14)]
    said = labelers.ColumnLabeler("s", lambda p: F.to_json(F.struct(F.concat(F.lit("summary of "), F.length(p).cast("string")).alias("value"))))
    digest = "\n".join(f"[user] {r[3][:400]}" for r in rows[:6])
    budget = dict(max_tokens=1900, collapse_over=100)
    with_model = collected(transcripts.compact(frame(spark, rows), summarizer=said, **budget))
    assert with_model[0][3] == f"{fixed.SUMMARY_HEADING}summary of {len(digest)}" and len(with_model) == 10
    failing = labelers.ColumnLabeler("f", lambda p: F.lit("oops"))
    for summarizer in (None, failing):
        plain = collected(transcripts.compact(frame(spark, rows), summarizer=summarizer, **budget))
        assert "Files touched: src/file0.py, src/file1.py" in plain[0][3] and "Errors seen: see src/file0.py" in plain[0][3]


def test_key_facts_are_bounded_and_ordered(spark):
    rows = [(1, t, "user", f"b{t:02d}.txt a{t:02d}.md\n  error {t} " + "e" * 200 + "\nfine") for t in range(30)] + [(2, 0, "user", "nothing")]
    info = {r["conv_id"]: r["info"] for r in transcripts.key_info(frame(spark, rows)).collect()}
    paths, errors = info[1].split("\n")
    assert paths == "Files touched: " + ", ".join(f"a{t:02d}.md" for t in range(20))
    assert errors == "Errors seen: " + "; ".join((f"error {t} " + "e" * 200)[:150] for t in range(5))
    assert info[2] == fixed.NO_KEY_INFO


def test_digest_of_a_very_long_conversation(spark):
    rows = [(1, t, "user", "w" if t % 5 else "") for t in range(9000)] + [(c, t, "user", f"t{t}") for c in (2, 3) for t in range(12)]
    got = {r["conv_id"]: r["digest"] for r in transcripts.keep_recent_digest(frame(spark, rows), keep=8).collect()}
    assert got[1] == "\n".join("[user] w" for t in range(8992) if t % 5)[:15000]
    assert got[2] == "[user] t0\n[user] t1\n[user] t2\n[user] t3"


def test_listing(spark):
    rows = [(c, t, role, f"{role} {c} " + "p" * 100) for c in range(30) for t, role in ((0, "system"), (2, "user"), (1, "user"))]
    rows += [(99, 0, "assistant", "no question")]
    listed = transcripts.conversation_list(frame(spark, rows), limit=20).collect()
    assert [r["conv_id"] for r in listed] == [99, *range(29, 10, -1)]
    assert listed[0]["preview"] == "" and listed[1]["preview"] == ("user 29 " + "p" * 100)[:80]


def test_cost(spark):
    usage = spark.createDataFrame([("m", 1_000_000, 500_000), ("other", 1000, 500)], "model string, prompt_tokens bigint, completion_tokens bigint")
    prices = spark.createDataFrame([("m", 2.5, 15.0)], "model string, input_price double, output_price double")
    assert {r["model"]: r["cost"] for r in transcripts.cost_estimate(usage, prices).collect()} == {"m": 10.0, "other": None}

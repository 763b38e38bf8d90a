"""Scores against a plain n-gram model held in dictionaries."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glossaframe.llm import lm_scoring


def tokens_of(text):
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b"\n"]


def plain(docs, order, prior):
    """[(id, held_out, n_tokens, n_known, N, base, score)] by the definition in words."""
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in docs]
    counts = Counter(tuple(t[j:j + k]) for (_, text), h in zip(docs, held) if not h for t in [tokens_of(text)]
                     for k in range(1, order + 1) for j in range(len(t) - k + 1))
    total, words = sum(n for g, n in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)

    def p(history, word):
        if not history:
            return (counts[(word,)] + 1) / (total + words + 1)
        return (counts[(*history, word)] + prior * p(history[1:], word)) / (counts[history] + prior)

    rows = []
    for (i, text), h in zip(docs, held):
        t = tokens_of(text)
        score = sum(math.log10(p(tuple(t[max(0, j - order + 1):j]), w)) for j, w in enumerate(t))
        base = sum(math.log10((counts[(w,)] + 1) / (total + words + 1)) for w in t)
        rows.append((i, h, len(t), sum(counts[(w,)] > 0 for w in t), total, base, score))
    return rows


def key(row):
    return row[0] is None, row[0], row[2:4], round(row[6], 6)


def same(found, wanted):
    found, wanted = sorted(map(tuple, found), key=key), sorted(wanted, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    for a, b in zip(found, wanted):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


COLUMNS = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, documents, order):
    rows = spark.createDataFrame(documents, "doc_id bigint, text string").repartition(5)
    same(lm_scoring.score_documents(rows, order=order).select(*COLUMNS).collect(), plain(documents, order, lm_scoring.PRIOR))


@pytest.mark.parametrize("order", [2, 3])
def test_small_blocks_and_buckets(spark, monkeypatch, order):
    """Texts that are cut into many blocks, each led by what comes before, and many buckets."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abc", k=2)) for _ in range(12)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(60)]
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", 16)
    monkeypatch.setattr(lm_scoring, "BUCKET_GRAMS", 64)
    monkeypatch.setattr(lm_scoring, "CUT_AT_ONCE", 20)
    monkeypatch.setattr(lm_scoring, "key_width", lambda n: 6)
    made = [lm_scoring._blocks(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1), "doc_id", "text", order)]
    assert made[0].count() > 100
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(2)
    same(lm_scoring.score_documents(rows, order=order).select(*COLUMNS).collect(), plain(docs, order, lm_scoring.PRIOR))


def test_odd_rows(spark, edge, none):
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    same(lm_scoring.score_documents(edge).select(*COLUMNS).collect(), plain(docs, 2, lm_scoring.PRIOR))
    assert lm_scoring.score_documents(none).collect() == []


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if lm_scoring.is_held_out(i))
    row = lm_scoring.score_documents(spark.createDataFrame([(held, "some words here")], "doc_id bigint, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (4, 0, 0, 0.0, 0.0)


def test_probabilities_add_up_to_one(spark):
    """After any history, over all words, the end, and one unknown word."""
    docs = [(i, t) for i, t in enumerate(["a b a c", "a b b", "c a b", ""]) if not lm_scoring.is_held_out(i)]
    held = [i for i in range(200) if lm_scoring.is_held_out(i)]
    tests = [(i, f"{h} {w}".strip()) for i, (h, w) in zip(held, [(h, w) for h in ("a", "b", "c") for w in ("a", "b", "c", "zz")])]
    table = spark.createDataFrame(docs + tests, "doc_id bigint, text string")
    scores = {r.id: r.score for r in lm_scoring.score_documents(table).collect()}
    model = {text: p for (i, text), p in ((t, 10 ** scores[t[0]]) for t in tests)}
    plain_scores = {r[0]: 10 ** r[6] for r in plain(docs + tests, 2, lm_scoring.PRIOR)}
    assert model == pytest.approx({t: plain_scores[i] for i, t in tests})


def test_better_than_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = lm_scoring.score_documents(docs).where("held_out").selectExpr("sum(score)", "sum(base_score)", "sum(n_tokens)").first()
    assert row[0] > 0.93 * row[1]  # log10 probabilities, so a smaller share is better
    assert row[0] - row[1] > 0.3 * row[2]


def test_steps_between_numbers():
    rng = np.random.default_rng(3)
    for width in (4, 5, 7, 8):
        for n in (0, 1, 1000):
            numbers = np.sort(rng.integers(0, 1 << 8 * width, n, dtype=np.uint64) if width < 8 else rng.integers(0, np.iinfo(np.uint64).max, n, dtype=np.uint64))
            assert (lm_scoring._steps_unpacked(lm_scoring._steps_packed(numbers, width), width) == numbers).all()


def test_sent_keys_are_smaller_than_the_hashes():
    """300,000 hashes of 7 bytes have some 38 bits between them; what goes to a shuffle is compressed with LZ4."""
    keys = np.sort(np.random.default_rng(4).integers(0, 1 << 56, 300_000, dtype=np.uint64))
    assert len(pa.compress(lm_scoring._steps_packed(keys, 7), "lz4_raw", asbytes=True)) < 0.75 * 7 * len(keys)

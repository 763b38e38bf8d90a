"""Variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from glossaframe.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def near_pairs(words):
    """All ordered pairs, by the strings that lack one letter (those of near words meet) and then the definition."""
    meet = {}
    for w in words:
        for lacking in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))}:
            meet.setdefault(lacking, []).append(w)
    return {(a, b) for some in meet.values() for a in some for b in some if a != b and one_edit(a, b)}


def plain(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [] for w in words}
    for a, b in near_pairs(list(words)):
        near[a].append(b)
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda b: (-words[b], b), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(rows)


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


def found(docs, **options):
    return sorted(map(tuple, spelling.group_variants(docs, **options).select(*COLUMNS).collect()))


@pytest.mark.parametrize("letters", ["ab", "abcdefghijé"])
def test_index_finds_what_all_pairs_give(letters):
    rng = random.Random(2)
    words = list({"".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(400)} | {letters[0] * 8, letters[1] * 9, "zz"})
    half = np.array([len(w) - len(w) // 2 for w in words])
    index = spelling.FMIndex(words)
    query, near = (f.tolist() for f in index.one_error(words, half))
    wanted = {(a, b) for a, b in near_pairs(words) if b.endswith(a[len(a) // 2:]) and one_edit(a[:len(a) // 2], b[:len(b) - len(a) + len(a) // 2])}
    assert {(words[q], index.words[n]) for q, n in zip(query, near)} == wanted
    assert len(query) == len(wanted)


@pytest.mark.parametrize("shard_words", [40, 1 << 14])
def test_near_words_of_a_crowd(spark, shard_words):
    """Hundreds of words that share their first or last letters, in shards that are cut into parts."""
    rng = random.Random(3)
    words = {"prefix" + "".join(rng.choices("ab", k=rng.randint(1, 7))) for _ in range(300)} | {"".join(rng.choices("ab", k=rng.randint(1, 7))) + "suffix" for _ in range(300)}
    words |= {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ééééééé", "ééééééè"}
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    rows = spelling.near_words(table, shard_words).collect()
    assert {(r.word, r.near) for r in rows} == near_pairs(list(words))
    assert len(rows) == len({(r.word, r.near) for r in rows})


def test_documents(spark, documents):
    rows = spark.createDataFrame(documents, "doc_id bigint, text string")
    assert found(rows) == plain(documents)


def test_forms_and_roots(spark):
    text = "elephant " * 400 + "elephent " * 30 + "elaphent " * 3 + "Elephan " * 39 + "Éléphant " * 20 + "elephants " * 40 + "solitary " * 2
    docs = [(1, text)]
    got = {r[0]: r for r in found(spark.createDataFrame(docs, "doc_id bigint, text string"))}
    assert list(got.values()) == plain(docs)
    assert got["elephent"][3] == "elephant" and got["elaphent"][3:] == ("elephent", 30, "elephant")
    assert got["elephants"][3:] == ("elephant", 400, "elephant") and got["solitary"][2:] == (0, None, None, "solitary")


def test_ties_go_to_the_first_word(spark):
    docs = [(1, "wordlyx " * 2 + "wordlya " * 20 + "wordlyb " * 20 + "wordlyé " * 20)]
    got = {r[0]: r[3] for r in found(spark.createDataFrame(docs, "doc_id bigint, text string"))}
    assert got["wordlyx"] == "wordlya"


def test_odd_rows(spark, edge, none):
    assert found(edge) == plain([(r.doc_id, r.text) for r in edge.collect()])
    assert found(none) == []


def test_very_long_words(spark):
    long = "ab" * 10_000
    docs = [(1, f"{long} {long} {long}b {long}b x{long} x{long} {long[:-1]}c {long[:-1]}c")]
    got = found(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert [r[2] for r in got] == [r[2] for r in plain(docs)]

"""Spelling variants: words one edit apart, found with FM-indexes, and the frequent form each rare spelling belongs to.

Words are cut out of whole texts and counted; those of at least LEAST_LENGTH letters and LEAST_COUNT occurrences make the
vocabulary. Two words are near if one inserted, deleted or replaced code point turns one into the other. The error then
lies in the second half of a word, and its near word begins with its first half, or it lies in the first half, and the
near word ends with its second half. So there are two searches (a search scheme for one error): match one half exactly
from its outer end, then go on across the other half with one error allowed.

Each search runs in an FM-index of the delimited vocabulary, one over the words as they are, which is searched from the
end of a word to its start, and one over the words written backwards. A search holds intervals of suffix ranks and
extends them by one letter at a time, for all words of a shard together.

The vocabulary is in no single place: the words of the first search are dealt to shards by their first letters, those of
the second by their last ones, as many as each half has at least, so a word meets all its near words. A shard that holds more than
SHARD_WORDS words, whatever the reason, is cut into parts that are indexed one by one and searched by all of its parts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH = 7
LEAST_COUNT = 2
DAMAGED_OF = 31
FORM_FACTOR = 10
SHARD_WORDS = 1 << 14
# distinct words that a task counts before it hands them on
MOST_COUNTED = 1 << 18
MOST_ROUNDS = 40


def damaged(doc_id, word: str) -> str:
    """The word, or for one in DAMAGED_OF (document, word) pairs, by checksum, the word without one of its letters."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % DAMAGED_OF:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1:]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
               least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of whole texts, in lower case (A-Z only), after `damaged`. A null text has none, a null id is
    written as nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def handed_on():
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                for word, n in Counter(RUN.findall(lower)).items():
                    if len(word) >= least_length:
                        word = damaged(doc_id, word)
                        if len(word) >= least_length:
                            found[word] += n
                if len(found) >= MOST_COUNTED:
                    yield handed_on()
        if found:
            yield handed_on()

    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class FMIndex:
    """An FM-index of words, each between delimiters, searched from the end of a word to its start.

    A state is an interval [low, high) of suffix ranks: the suffixes that begin with what is matched so far. Extending it
    by a letter to the left counts that letter in the transform before either end; these counts come from the sorted
    positions of each letter. Words are sorted, so delimiters, which are ordered by what follows them, are in order of place.
    """

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        points = np.frombuffer(("\0" + "\0".join(self.words) + "\0").encode("utf-32-le"), "<u4")
        self.alphabet, text = np.unique(points, return_inverse=True)
        self.size, self.letters = len(text), len(self.alphabet)
        self.word_at = np.cumsum(text == 0) - 1  # the word that begins after this delimiter, or holds this letter
        self.suffixes = self._suffixes(text)
        self.transform = text[self.suffixes - 1]
        self.keys = np.sort(self.transform * np.int64(self.size + 1) + np.arange(self.size))  # positions letter by letter

    def _suffixes(self, text: np.ndarray) -> np.ndarray:
        """Starts of the suffixes in their order, by prefix doubling: ranks by 2k letters from those by k."""
        ranks, k = text.astype(np.int64), 1
        while True:
            keys = ranks * (self.size + 1)
            keys[:-k] += ranks[k:] + 1
            order = np.argsort(keys, kind="stable")
            ranks[order] = np.cumsum(np.concatenate([[0], np.diff(keys[order]) != 0]))
            k *= 2
            if ranks[order[-1]] == self.size - 1:
                return order

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words' letters in the alphabet, each word's last letter first and 0 behind it, and where each word
        begins; -1 for letters that the alphabet lacks."""
        points = np.frombuffer(("\0".join(w[::-1] for w in words) + "\0").encode("utf-32-le"), "<u4")
        at = np.minimum(np.searchsorted(self.alphabet, points), self.letters - 1)
        ends = np.flatnonzero(points == 0)
        return np.where(self.alphabet[at] == points, at, -1), np.concatenate([[0], ends[:-1] + 1])

    def extended(self, low: np.ndarray, high: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = letter * np.int64(self.size + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(state, letter, low, high) of the extensions of each state by all letters that give one, delimiters left out."""
        narrow = high - low <= self.letters
        some = np.flatnonzero(narrow)
        sizes = (high - low)[some]
        at = np.repeat(low[some] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        pairs = np.unique(np.repeat(some, sizes) * np.int64(self.letters) + self.transform[at])
        wide = np.flatnonzero(~narrow)
        pairs = np.concatenate([pairs, np.repeat(wide * np.int64(self.letters), self.letters) + np.tile(np.arange(self.letters), len(wide))])
        state, letter = pairs // self.letters, pairs % self.letters
        new_low, new_high = self.extended(low[state], high[state], letter)
        fits = (letter > 0) & (new_high > new_low)
        return state[fits], letter[fits], new_low[fits], new_high[fits]

    def one_error(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) for each query and each indexed word exactly one edit away whose last `exact[query]` letters are
        those of the query."""
        n = len(words)
        (codes, starts), sizes = self.codes(words), np.fromiter(map(len, words), np.int64, n)
        query, low, high = np.arange(n), *self.extended(np.zeros(n, np.int64), np.full(n, self.size), np.zeros(n, np.int64))
        e_query, e_low, e_high = (np.zeros(0, np.int64) for _ in range(3))
        met: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(query) or len(e_query):
            letter = codes[starts[query] + step]
            may = step >= exact[query]
            b_query, b_low, b_high, b_letter = query[may], low[may], high[may], letter[may]
            state, other, c_low, c_high = self.children(b_low, b_high)
            # an inserted letter, after which this step's letter (or the delimiter) must follow
            i_query = np.concatenate([e_query, b_query[state]])
            i_letter = codes[starts[i_query] + step]
            i_low, i_high = self.extended(np.concatenate([e_low, c_low]), np.concatenate([e_high, c_high]), i_letter)
            fits, ended = (i_high > i_low) & (i_letter >= 0), sizes[i_query] == step
            done, goes_on = fits & ended, fits & ~ended
            met.append((i_query[done], i_low[done]))
            # a replaced letter, or one left out
            inside = sizes[b_query] > step
            replaced = inside[state] & (other != b_letter[state])
            e_query = np.concatenate([i_query[goes_on], b_query[state][replaced], b_query[inside]])
            e_low = np.concatenate([i_low[goes_on], c_low[replaced], b_low[inside]])
            e_high = np.concatenate([i_high[goes_on], c_high[replaced], b_high[inside]])
            e_query, e_low, e_high = self._distinct(e_query, e_low, e_high)
            # and the letter itself
            new_low, new_high = self.extended(low, high, letter)
            alive = (sizes[query] > step) & (new_high > new_low) & (letter >= 0)
            query, low, high, step = query[alive], new_low[alive], new_high[alive], step + 1
        if not met:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, ranks = (np.concatenate([m[k] for m in met]) for k in (0, 1))
        pairs = np.unique(found * np.int64(len(self.words)) + self.word_at[self.suffixes[ranks]])
        return pairs // len(self.words), pairs % len(self.words)

    @staticmethod
    def _distinct(query: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same place reached in two ways (such as either of two equal letters left out) is one state."""
        order = np.lexsort((high, low, query))
        query, low, high = query[order], low[order], high[order]
        fresh = np.concatenate([[True], (query[1:] != query[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])[: len(query)]
        return query[fresh], low[fresh], high[fresh]


def _searched(table: pa.Table) -> pa.Table:
    """The near words that one part of a shard finds in another: rows with `indexed` are the part that is indexed, the others search."""
    backwards = table["backwards"][0].as_py()
    rows = table.select(["word", "n", "indexed"]).to_pylist()
    indexed = {(r["word"][::-1] if backwards else r["word"]): r for r in rows if r["indexed"]}
    queries = [r for r in rows if not r["indexed"]]
    if not indexed or not queries:
        return pa.table({k: pa.array([], t) for k, t in _FOUND.items()})
    index = FMIndex(list(indexed))
    sizes = np.array([len(r["word"]) for r in queries])
    found = index.one_error([r["word"][::-1] if backwards else r["word"] for r in queries], sizes // 2 if backwards else sizes - sizes // 2)
    pairs = [(queries[q], indexed[index.words[w]]) for q, w in zip(*(f.tolist() for f in found))]
    return pa.table({"word": pa.array([a["word"] for a, _ in pairs], pa.string()), "near": pa.array([b["word"] for _, b in pairs], pa.string()),
                     "near_n": pa.array([b["n"] for _, b in pairs], pa.int64())})


_FOUND = {"word": pa.string(), "near": pa.string(), "near_n": pa.int64()}


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, near, near_n): every ordered pair of near words of a vocabulary (word, n) of distinct words, all of at least
    `least_length` code points, which must be 2 or more. Each pair comes once."""
    shards = max(1, -(-words.count() // shard_words))
    # a word's halves, the shorter one first, have this many letters at least, and a near word shares one of them
    first, last = least_length // 2, least_length - least_length // 2
    ends = F.array(F.struct(F.lit(True).alias("backwards"), F.substring("word", 1, first).alias("end")),
                   F.struct(F.lit(False).alias("backwards"), F.expr(f"right(word, {last})").alias("end")))
    dealt = stage(words.select("word", "n", F.explode(ends).alias("x")).select("word", "n", "x.backwards", F.pmod(F.xxhash64("x.end"), F.lit(shards)).alias("shard")),
                  "spelling-shards")
    # a shard of more words than `shard_words` is cut into parts, by hash; each part is indexed and searched by each
    sizes = dealt.groupBy("backwards", "shard").count().select("backwards", "shard", F.ceil(F.col("count") / shard_words).cast("int").alias("parts"))
    sized = dealt.join(sizes, ["backwards", "shard"]).withColumn("part", F.pmod(F.xxhash64("word", F.lit(1)), "parts").cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    roles = F.concat(F.transform(every, lambda p: F.struct(F.lit(True).alias("indexed"), F.col("part").alias("index"), p.alias("query"))),
                     F.transform(every, lambda p: F.struct(F.lit(False).alias("indexed"), p.alias("index"), F.col("part").alias("query"))))
    cells = sized.select("backwards", "shard", "word", "n", F.explode(roles).alias("x")).select("backwards", "shard", "word", "n", "x.*")
    # small tables and long searches: as many tasks as shards, whatever their size in bytes
    cell = ["backwards", "shard", "index", "query"]
    found = cells.repartition(2 * shards, *cell).groupBy(*cell).applyInArrow(_searched, "word string, near string, near_n bigint")
    return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form): where following forms from each word ends. Forms must not lead in a circle.
    Each round doubles the steps that a word has gone."""
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(MOST_ROUNDS):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stage(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                       "spelling-roots")
        now = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return now
    raise RuntimeError(f"forms did not end in {MOST_ROUNDS} rounds")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = FORM_FACTOR,
                   shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of the vocabulary.

    `form` is the word's most frequent near word, of equals the first in code-point order, if it occurs at least `factor`
    (2 or more) times as often, else null; `root` is where forms lead, the word itself without one. Counts grow along
    forms, so these end. A table without words gives no rows; repeated rows count each.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more")
    words = stage(vocabulary(docs, id_col, text_col), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(words, shard_words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    found = words.join(near, "word", "left").withColumn("strong", -F.col("best.less") >= factor * F.col("n"))
    formed = stage(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("strong"), F.col("best.near")).alias("form"),
                                F.when(F.col("strong"), -F.col("best.less")).alias("form_n")), "spelling-forms")
    ends = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))

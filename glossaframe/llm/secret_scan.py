"""Secrets in texts: three fixed shapes, and values in a credential's context that would take too many guesses.

The guess cost of a value is the least, over all ways to cut it into segments, of the summed log10 guesses of its
segments: common words, dates, repeats, keyboard walks, sequences, and brute-force spans. A dynamic program over end
positions finds it. A value that costs at least MIN_GUESSES_LOG10 is reported as kind "guess".

Words are ranked: a few common parts of chosen passwords, then the MOST_WORDS most frequent words of the corpus, counted
over all its texts. A context word begins at no letter, or at a capital after a small one, so "bypass:" is none. A value
in quotes ends at its closing quote. Null and empty texts have no spans; rows and ids may repeat.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stage
from .files import discard

KINDS = ("assign", "access", "hex", "guess")
# letters of the assign kind match in either case, in ASCII only
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 6
# a run of the class is at least this long or no match, which says the same as dropping shorter runs afterwards
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# what may stand before a value that is worth scoring, beyond the assign shape, with the scheme of an authorization header;
# values are taken whole, from SHORTEST characters on, with Latin letters beyond ASCII
CONTEXT = re.compile(r"""(?:(?<![A-Za-z\u00C0-\u024F])|(?-i:(?<=[a-z])(?=[A-Z])))(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?|bearer)["']?\x20{0,8}(?:=>|:=|[:=])\x20{0,8}(?P<quote>["'])?+(?:(?:basic|bearer|digest|negotiate|ntlm|token|api-?key|oauth|hawk|dpop|key)\x20++)?+(?P<value>(?(quote)(?:(?!(?P=quote))[!-~\u00C0-\u024F]){7,}|[!-~\u00C0-\u024F]{7,}))""", re.I | re.A)
MIN_GUESSES_LOG10 = 12.0
# the fewest characters of which the largest class costs that much
SHORTEST = 7
# longest segment of a pattern; brute-force spans are not limited
LONGEST_WORD = 24
# words of the corpus that are ranked and sent to the workers, at most LONGEST_WORD characters each
MOST_WORDS = 1 << 15
# common parts of chosen passwords, most common first: the rank is the number of guesses
WORDS = ("password", "admin", "welcome", "letmein", "login", "master", "dragon", "monkey", "shadow", "secret", "test",
         "user", "root", "guest", "hello", "love", "pass", "change", "example", "default", "token", "null", "none", "true",
         "false", "your", "here", "value", "string", "abc", "summer", "winter", "spring", "autumn", "please", "name", "key")
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890")
WORD = re.compile(rf"""["'(\[]{{0,2}}([A-Za-z\u00C0-\u024F]{{3,{LONGEST_WORD}}})[.,;!?"')\]]{{0,3}}""")
AFTER_SIGN = re.compile(r"[:=]\s*\S+")
# parts of a doubling at which word counts are cut; counts below 2 * STEPS / 3 have a step each
STEPS = 64
# distinct pieces that a task counts before it hands them on
MOST_COUNTED = 1 << 18
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
DATE_GUESSES = 5.0  # log10 of a century of days and their spellings
RANK: Mapping[str, int] = {word: i + 1 for i, word in enumerate(WORDS)}
NEIGHBOURS = frozenset(x for row in ROWS for a, b in zip(row, row[1:]) for x in (a + b, b + a))
LEET = str.maketrans("@430157$!", "aaeoistsi")


def ranked_words(docs: DataFrame, text_col: str = "text", most: int = MOST_WORDS) -> dict[str, int]:
    """Ranks from 1: WORDS, then the most frequent words of all texts, `most` at the most (ties: in code-point order).

    Counts are cut at steps of 1 / STEPS of a doubling, and a step is taken whole or not at all, so that the driver gets
    these steps' sizes and the words that are ranked, whatever the number of words.
    A word here is a blank-separated piece that is nothing but 3 to LONGEST_WORD Latin letters and punctuation around
    them. What follows a colon or an equals sign is not counted, so that values of credentials do not become words.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for piece, n in pieces.items():
                if (m := WORD.fullmatch(piece)) is not None:
                    words[m[1].lower()] += n
            pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                pieces.update(AFTER_SIGN.sub(" ", text or "").split())
                if len(pieces) >= MOST_COUNTED:
                    yield counted()
        yield counted()

    words = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n bigint").where(~F.col("word").isin(*WORDS))
    counts = words.groupBy("word").agg(F.sum("n").alias("n"))
    counts = stage(counts.withColumn("step", F.floor(F.log2("n") * STEPS).cast("int")), "word-counts")
    chosen, held = None, 0
    for r in sorted(counts.groupBy("step").count().collect(), reverse=True):
        held += r["count"]
        if held > most:
            break
        chosen = r["step"]
    top = [] if chosen is None else sorted((-r["n"], r["word"]) for r in counts.where(F.col("step") >= chosen).collect())
    discard(counts)
    return {**RANK, **{word: len(RANK) + i + 1 for i, (_, word) in enumerate(top)}}


def _class_size(value: str) -> int:
    return sum(size for size, has in ((26, any("a" <= c <= "z" for c in value)), (26, any("A" <= c <= "Z" for c in value)),
                                      (10, any("0" <= c <= "9" for c in value)), (33, any(not (c.isascii() and c.isalnum()) for c in value))) if has)


def guess_cost(value: str, ranks: Mapping[str, int] = RANK) -> float:
    """log10 of the guesses for the cheapest segmentation of `value`; 0 for an empty one.

    best[j] is the cost of value[:j]. A brute-force span from i adds the same for each character, so extending it is
    one step back; every other segment ends at j and starts within a bounded distance, except repeats and keyboard
    walks, of which the start of the longest one that ends at j is kept while going along.
    """
    n = len(value)
    if not n:
        return 0.0
    lower = value.lower()
    plain = lower.translate(LEET)
    per_char = math.log10(max(2, _class_size(value)))
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if (m := DATE.match(value, i)) is not None:
            dates.setdefault(m.end(), []).append(i)
    best = [0.0] + [math.inf] * n
    run = walk = step = 0  # starts of the run of one character, the keyboard walk and the steady sequence at hand
    for j in range(1, n + 1):
        if j > 1:
            a, b = lower[j - 2], lower[j - 1]
            run = run if a == b else j - 1
            walk = walk if a + b in NEIGHBOURS else j - 1
            if j == 2 or ord(b) - ord(a) != ord(lower[j - 2]) - ord(lower[j - 3]) or abs(ord(b) - ord(a)) != 1:
                step = j - 2 if abs(ord(b) - ord(a)) == 1 else j - 1
        cost = best[j - 1] + per_char
        for i in range(max(0, j - LONGEST_WORD), j - 2):
            rank = ranks.get(lower[i:j]) or ranks.get(plain[i:j])
            if rank:
                spelled = 1 + sum(x != y for x, y in zip(value[i:j], lower[i:j])) + sum(x != y for x, y in zip(lower[i:j], plain[i:j]))
                cost = min(cost, best[i] + math.log10(rank * spelled + 1))
        for i in dates.get(j, ()):
            cost = min(cost, best[i] + (DATE_GUESSES if j - i > 4 else 2.0))
        for start, base in ((run, per_char), (walk, 2.0), (step, 2.0)):
            if j - start >= 3:
                cost = min(cost, best[start] + base + math.log10(j - start))
        best[j] = cost
    return best[n]


def _stretches(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the sorted spans cover together."""
    starts, ends = [], []
    for start, _, end in spans:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def find(text: str, ranks: Mapping[str, int] = RANK) -> list[tuple[int, int, int]]:
    """All spans as (start, kind's place in KINDS, end), in order. Base spans are always there; a guess span is added
    for a scored value that reaches beyond them."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    starts, ends = _stretches(base)
    added = []
    for m in CONTEXT.finditer(text):
        value = m["value"].rstrip("\"'`,;.)]}>")
        start, end = m.start("value"), m.start("value") + len(value)
        k = bisect_right(starts, start) - 1
        covered = k >= 0 and end <= ends[k]
        if len(value) >= SHORTEST and not covered and guess_cost(value, ranks) >= MIN_GUESSES_LOG10:
            added.append((start, 3, end))
    return sorted(base + added)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: Mapping[str, int] | None = None) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_guess, base_spans, base_sha256, spans) of every row's whole text; spans are
    kind:start:end in code points, comma-joined, by start and then kind. One row for each row of the input. Without `ranks` words are counted first."""
    import pyarrow as pa

    known = docs.sparkSession.sparkContext.broadcast(ranked_words(docs, text_col) if ranks is None else dict(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = find(text or "", known.value)
                base = _joined([s for s in spans if s[1] < 3])
                kinds = [s[1] for s in spans]
                rows.append((*map(kinds.count, range(4)), base, hashlib.sha256(base.encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    names = ["id", "n_assign", "n_access", "n_hex", "n_guess", "base_spans", "base_sha256", "spans"]
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_spans string, base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def redact_text(text: str | None, ranks: Mapping[str, int] = RANK) -> str | None:
    """`text` with each covered stretch replaced by [kind]; overlapping spans make one stretch, named by its first."""
    if not text:
        return text
    out, at, low = [], 0, None
    for start, kind, end in [*find(text, ranks), (len(text) + 1, 0, 0)]:
        if low is not None and start >= low[2]:
            out += [text[at: low[0]], f"[{KINDS[low[1]]}]"]
            at, low = low[2], None
        low = (start, kind, end) if low is None else (low[0], low[1], max(low[2], end))
    return "".join([*out, text[at:]])


def redacted(text: Column) -> Column:
    """The text without its secrets, scored by the fixed words alone. Null stays null."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(redact_text)

    return of(text)


def redact(docs: DataFrame, text_col: str = "text", ranks: Mapping[str, int] | None = None) -> DataFrame:
    """All rows and columns, without the secrets of the text column. Without `ranks` words are counted first."""
    known = docs.sparkSession.sparkContext.broadcast(ranked_words(docs, text_col) if ranks is None else dict(ranks))

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: redact_text(text, known.value))

    return docs.withColumn(text_col, of(F.col(text_col)))

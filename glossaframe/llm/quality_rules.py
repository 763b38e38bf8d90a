"""Quality of documents by weak supervision.

Rules look at a document and vote for it, against it, or abstain. How often each rule is right is not known
beforehand: expectation-maximisation over the votes on all documents estimates the accuracies and the share of good
documents, and every document gets the probability that it is good. Documents that fail the two base limits go anyway.

What the estimation needs is the number of documents for each pattern of votes. There are 3 to the power of the number
of rules patterns at most, so this count is small whatever the size of the corpus, and documents with equal votes have
equal probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stage

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
ROUNDS = 100
# before the votes are seen: share of good documents, and each rule's chance to be right when it votes
PRIOR, ACCURACY = 0.8, 0.8
KEEP_FROM = 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_ends", "n_marks"]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words found twice or more in the text."""
    if len(words) < WINDOW + 1:
        return 0
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return covered


def counts_of(text: str | None) -> tuple[int, ...]:
    """The numbers named in COUNTS for one whole text. A null text has no words."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    blanks = sum(data.count(c) for c in b" \t\n\x0b\x0c\r")
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = upper + len(data) - len(data.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    ends = sum(line.rstrip()[-1:] in b".!?:;\"')" for line in lines)
    return (len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
            len(lines), upper, letters, ends, text.count("!") + text.count("?"))


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ...) with the numbers named in COUNTS for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([counts_of(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, table)], ["id", *COUNTS])

    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Each rule's vote from a document's counts: 1 good, -1 bad, 0 abstain."""
    words, lines, letters = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "n_letters"))

    def low_is_good(value: Column, good: float, bad: float) -> Column:
        return F.when(value <= good, 1).when(value > bad, -1).otherwise(0)

    mean = F.col("word_chars") / words
    ends = F.col("n_ends") / lines
    return {
        "symbols": low_is_good(F.col("n_symbols") / words, 0.02, 0.1),
        "capitals": F.when(F.col("n_letters") < 20, 0).otherwise(low_is_good(F.col("n_upper") / letters, 0.15, 0.5)),
        "marks": low_is_good(F.col("n_marks") / words, 0.05, 0.3),
        "word_length": F.when((mean >= 3) & (mean <= 10), 1).when((mean < 2.5) | (mean > 14), -1).otherwise(0),
        "line_ends": F.when(ends >= 0.6, 1).when(ends < 0.3, -1).otherwise(0),
        "repeated_lines": F.when(F.col("n_lines") < 2, 0).otherwise(low_is_good(F.col("n_dup_lines") / lines, 0.05, 0.3)),
        "repeated_words": low_is_good(F.col("n_repeat_words") / words, 0.05, 0.15),
        "length": F.when(F.col("n_words") >= 50, 1).when(F.col("n_words") < 15, -1).otherwise(0),
    }


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation for independent rules. `votes` has a row for each pattern with 1, -1 or 0 for each rule.

    Returns the share of good documents, for each rule its chance to vote well on good and on bad documents given that
    it votes, and each pattern's probability to be good. Estimates are smoothed by one document of the prior each, and
    no rule is let fall below an even chance, so good and bad cannot change places. Without documents the priors stay.
    """
    share, right = PRIOR, np.full((2, votes.shape[1]), ACCURACY)
    good = np.full(len(votes), PRIOR)
    for _ in range(rounds):
        right_log, wrong_log = np.log(right), np.log(1 - right)
        if_good = np.log(share) + np.where(votes > 0, right_log[0], np.where(votes < 0, wrong_log[0], 0)).sum(axis=1)
        if_bad = np.log(1 - share) + np.where(votes < 0, right_log[1], np.where(votes > 0, wrong_log[1], 0)).sum(axis=1)
        good = 1 / (1 + np.exp(np.clip(if_bad - if_good, -700, 700)))
        for k, (sure, sign) in enumerate(((good * counts, 1), ((1 - good) * counts, -1))):
            hits, cast = (sure[:, None] * (votes == sign)).sum(axis=0), (sure[:, None] * (votes != 0)).sum(axis=0)
            right[k] = np.clip((hits + ACCURACY) / (cast + 1), 0.5, 0.999)
        share = float(np.clip(((good * counts).sum() + PRIOR) / (counts.sum() + 1), 0.01, 0.99))
    return share, right, good


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts..., votes, p_good, base_failed, kept) for every row."""
    named = rules()
    counted = stage(document_counts(docs, id_col, text_col), "document-counts")
    voted = counted.withColumn("votes", F.concat_ws("", *[F.when(v > 0, "+").when(v < 0, "-").otherwise("0") for v in named.values()]))
    patterns = voted.groupBy("votes").count().toArrow().to_pylist()  # at most 3 ** len(named) rows
    table = np.array([[{"+": 1, "-": -1, "0": 0}[v] for v in row["votes"]] for row in patterns]).reshape(-1, len(named))
    _, _, good = estimate(table, np.array([row["count"] for row in patterns], float))
    spark = docs.sparkSession
    scored = spark.createDataFrame([(row["votes"], float(p)) for row, p in zip(patterns, good)], "votes string, p_good double")
    return (voted.join(F.broadcast(scored), "votes").withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_FROM))
            .select("id", *COUNTS, "votes", "p_good", "base_failed", "kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the rows that are kept. A row is known by its id and a hash of its text, so rows that share an id, or
    have none, are judged each; rows of equal id and text are judged alike."""
    marked = docs.withColumn("__row", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")))
    kept = judged(marked, "__row", text_col).where("kept").select("id.*").distinct()
    same = F.col("__row.id").eqNullSafe(kept["id"]) & (F.col("__row.text_hash") == kept["text_hash"])
    return marked.join(kept.select("id", "text_hash"), same, "left_semi").drop("__row")

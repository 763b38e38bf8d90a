"""Text expressions: lines, tokens, n-grams, truncation, polarity. All run inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed

# letters and digits of any script; everything else separates words
NON_WORD = r"[^\p{L}\p{N}]+"
WORD_CHARACTER = r"[\p{L}\p{N}]"
# punctuation around all words of a text at once: next to white space or an end of the text
EDGE_PUNCTUATION_IN_TEXT = r"(?<=^|\s)[^\p{L}\p{N}\s]+|[^\p{L}\p{N}\s]+(?=\s|\z)"


def text_or_empty(column: Column) -> Column:
    """Null text counts as empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def lines(text: Column) -> Column:
    """Lines of a text without their ends; a final line break opens no further line."""
    closed = F.regexp_replace(text, f"(?:{fixed.LINE_BREAK})\\z", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(closed, fixed.LINE_BREAK))


def ellipsis(text: Column, limit: int) -> Column:
    """Cut to `limit` characters, the last three of which become dots when something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def single_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def words(text: Column) -> Column:
    """Lower-cased words: runs of letters and digits."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), NON_WORD, " "), " "), "")


def norm_words(text: Column) -> Column:
    """The words between white space, lower-cased, without the punctuation around them."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(text, EDGE_PUNCTUATION_IN_TEXT, "")), r"\s+"), "")


def surface_forms(text: Column) -> Column:
    """The words of `norm_words` as they are written: what stands between white space and has a letter or a digit."""
    return F.filter(F.split(text, r"\s+"), lambda w: w.rlike(WORD_CHARACTER))


def with_ngrams(df: DataFrame, tokens: str, out: str, low: int, high: int) -> DataFrame:
    """Add every distinct run of `low`..`high` consecutive tokens, joined by a blank."""
    made = []
    for n in range(max(2, low), high + 1):
        made.append(f"__gram{n}")
        df = NGram(n=n, inputCol=tokens, outputCol=made[-1]).transform(df)
    parts = ([tokens] if low == 1 else []) + made
    return df.withColumn(out, F.array_distinct(F.concat(*parts))).drop(*made)


def explode_values(df: DataFrame, keep: list, array: Column, name: str) -> DataFrame:
    """One row per element of an array that is costly to compute and holds no nulls.

    A plain `explode` lets the optimizer add a filter for non-empty arrays below it, which computes the array
    a second time; the outer form does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def number_lines(df: DataFrame, keep: list, text: Column) -> DataFrame:
    """One row per line of a text: `pos` from 0 and `line`."""
    return df.select(*keep, F.posexplode_outer(lines(text)).alias("pos", "line")).where(F.col("line").isNotNull())


def contains_any(text: Column, needles: list[str]) -> Column:
    """Plain substring tests, which are much cheaper than an alternation in a regular expression."""
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def matches(text: Column, pattern: str) -> Column:
    """Whether a pattern is found. Alternatives without special characters are tested as substrings."""
    if re.fullmatch(r"[\w @#&:;,<>=/'\"-]+(?:\|[\w @#&:;,<>=/'\"-]+)*", pattern):
        return contains_any(text, pattern.split("|"))
    return text.rlike(pattern)


def _has_word(text: Column, needles: list[str], whole_words: bool) -> Column:
    found = contains_any(text, needles)
    if whole_words:
        found = found & text.rlike(r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(needles) + r")(?:[^\p{L}\p{N}_]|$)")
    return found


def infer_polarity(*parts: Column, phrases: bool = False, whole_words: bool = False) -> Column:
    """'negative', 'positive' or null from the words of a goal, filter or any text.

    Negative words win. The plain mode looks for substrings, so 'posts' reads as positive; `whole_words`
    needs the word to stand alone. `phrases` adds the extra word used when mining issue phrases.
    """
    text = F.lower(F.concat_ws(" ", *[text_or_empty(p) for p in parts]))
    negative = fixed.NEGATIVE_PHRASE_WORDS if phrases else fixed.NEGATIVE_WORDS
    return F.when(_has_word(text, negative, whole_words), "negative").when(
        _has_word(text, fixed.POSITIVE_WORDS, whole_words), "positive"
    )


def polarity_of(*texts: str | None, phrases: bool = False) -> str | None:
    """The same rule for one goal known on the driver, before any Spark work starts."""
    text = " ".join(t or "" for t in texts).lower()
    if any(w in text for w in (fixed.NEGATIVE_PHRASE_WORDS if phrases else fixed.NEGATIVE_WORDS)):
        return "negative"
    if any(w in text for w in fixed.POSITIVE_WORDS):
        return "positive"
    return None

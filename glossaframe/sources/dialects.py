"""The delimiter and quote of a CSV file, from a bounded sample of its first lines."""

from __future__ import annotations

import csv
import re
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# the sample: at most so many lines, of so many characters each
HEAD_LINES = 200
HEAD_CHARS = 1 << 16
DELIMITERS = (",", ";", "\t", "|")
QUOTES = ('"', "'")


class Dialect(NamedTuple):
    sep: str
    quote: str


def detect(spark: SparkSession, path: str) -> Dialect:
    """The dialect in which the sampled records agree; a file without a delimiter in its header has one column.

    Only the head is read: lines from one split, up to HEAD_LINES. Raises ValueError if no dialect agrees.
    """
    head = spark.read.text(path).select(F.substring("value", 1, HEAD_CHARS + 1).alias("line")).limit(HEAD_LINES)
    lines = [r["line"] for r in head.collect()]
    whole = next((i for i, line in enumerate(lines) if len(line) > HEAD_CHARS), len(lines))
    if whole == 0 and lines:
        raise ValueError(f"the header is longer than {HEAD_CHARS} characters: give `sep`")
    return detect_in(lines[:whole], cut=len(lines) == HEAD_LINES or whole < len(lines))


def detect_in(lines: list[str], cut: bool = False) -> Dialect:
    """The dialect of these lines; `cut` says that more may follow, so that the last record may be incomplete.

    The quote is the one that wraps more values. A delimiter agrees if it divides every record that is not empty into
    the same number of fields, two or more; of those that agree, the one with most fields wins.
    """
    while lines and not lines[0]:
        lines = lines[1:]
    if not lines:
        return Dialect(",", '"')
    edge = "[" + re.escape("".join(DELIMITERS)) + "]"
    text = "\n".join(lines)
    wrapped = [len(re.findall(rf"(?:^|(?<={edge})){q}[^{q}]*{q}(?=$|{edge})", text, re.M)) for q in QUOTES]
    quote = QUOTES[wrapped[1] > wrapped[0]]
    agreed, seen = [], False
    for sep in DELIMITERS:
        counts = _field_counts(lines, sep, quote, cut)
        seen = seen or (counts[:1] or [1])[0] > 1
        if counts and counts[0] > 1 and len(set(counts)) == 1:
            agreed.append((counts[0], sep))
    if agreed:
        return Dialect(max(agreed, key=lambda x: x[0])[1], quote)
    if not seen:
        return Dialect(",", quote)
    raise ValueError("no delimiter divides the first rows into equally many fields (malformed rows?): give `sep`")


def _field_counts(lines: list[str], sep: str, quote: str, cut: bool) -> list[int]:
    """Numbers of fields of the records, without the last one of a sample that may end within it."""
    rows = list(csv.reader((line + "\n" for line in lines), delimiter=sep, quotechar=quote, doublequote=True))
    if cut and len(rows) > 1:
        rows = rows[:-1]
    return [len(r) for r in rows if r]

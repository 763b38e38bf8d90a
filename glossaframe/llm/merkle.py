"""Document fingerprints as Merkle trees, in DataFrame functions only.

A text is cut without a gap or overlap into sections (up to a blank line), paragraphs (up to a line break) and runs (up
to the end of a sentence, eight words at most). A run's digest is its MD5, a paragraph's the MD5 of its runs' digests,
and so on up to the root. Equal roots mean equal texts. Where roots differ, equal branches are skipped and the rest
tells which paragraphs were edited.

The fingerprint is a string: the root, a colon, and the first 8 hexadecimal digits of every run's digest, with "," after
a paragraph and ";" after a section, so two fingerprints can be compared without their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stage

SECTION_END = r"(?<=\n\n)"
PARAGRAPH_END = r"(?<=\n)"
# up to seven words that end no sentence, then one word of any kind; or blanks alone
RUN = r"\s*(?:\S*[^\s.!?]\s+){0,7}\S+\s*|\s+"
SHORT = 8


def _parts(text: Column, end: str) -> Column:
    return F.filter(F.split(text, end), lambda part: part != "")


def tree(text: Column) -> Column:
    """Digests of runs, nested by section and paragraph. A null or empty text has no section."""
    return F.transform(_parts(F.coalesce(text, F.lit("")), SECTION_END), lambda section: F.transform(
        _parts(section, PARAGRAPH_END), lambda paragraph: F.transform(F.regexp_extract_all(paragraph, F.lit(RUN), F.lit(0)), F.md5)))


def _up(digests: Column) -> Column:
    return F.md5(F.array_join(digests, ""))


def fingerprint_of(digests: Column) -> Column:
    """The fingerprint string of a `tree`."""
    root = _up(F.transform(digests, lambda section: _up(F.transform(section, _up))))
    short = F.array_join(F.transform(digests, lambda section: F.concat(F.array_join(F.transform(section, lambda runs: F.concat(
        F.array_join(F.transform(runs, lambda run: F.substring(run, 1, SHORT)), ""), F.lit(","))), ""), F.lit(";"))), "")
    return F.concat(root, F.lit(":"), short)


def fingerprint(text: Column) -> Column:
    return fingerprint_of(tree(text))


def root_of(mark: Column) -> Column:
    """Equal for equal texts only."""
    return F.substring_index(mark, ":", 1)


def runs_of(mark: Column) -> Column:
    """The short digests of a fingerprint's runs."""
    return F.regexp_extract_all(F.substring_index(mark, ":", -1), F.lit("[0-9a-f]{%d}" % SHORT), F.lit(0))


def _likeness(left: Column, right: Column, equal: Column) -> Column:
    ours, theirs = F.array_distinct(left), F.array_distinct(right)
    both = 2.0 * F.size(F.array_intersect(ours, theirs)) / (F.size(ours) + F.size(theirs))
    return F.when(equal, 1.0).when((F.size(ours) == 0) | (F.size(theirs) == 0), 0.0).otherwise(both)


def likeness(left: Column, right: Column) -> Column:
    """1 for equal roots, else twice the shared distinct runs by the distinct runs of both (0 if one has none)."""
    return _likeness(runs_of(left), runs_of(right), root_of(left) == root_of(right))


def edited_paragraphs(left: Column, right: Column) -> Column:
    """Positions (from 0, over the whole text) of the paragraphs of `left` that `right` has not; empty for equal roots."""
    def paragraphs(mark: Column) -> Column:
        return F.filter(F.split(F.translate(F.substring_index(mark, ":", -1), ";", ""), ","), lambda p: p != "")

    theirs = paragraphs(right)
    found = F.filter(F.transform(paragraphs(left), lambda p, i: F.when(~F.array_contains(theirs, p), i)), lambda i: i.isNotNull())
    return F.when(root_of(left) == root_of(right), F.array().cast("array<int>")).otherwise(found)


def next_keys(keys: DataFrame, order: list[str]) -> DataFrame:
    """Each row with the next row's `key` in `order` as `next_key`; the last row gets the first row's.

    Rows are dealt out by range and written, each partition finds its rows' successors, and only the first row of each
    partition, one row per partition, is brought together to join the ends.
    """
    spread = keys.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("part", F.spark_partition_id())
    dealt = stage(spread, "ordered-keys")
    by_order = [F.col(c).asc_nulls_first() for c in order]
    within = dealt.withColumn("following", F.lead("key").over(Window.partitionBy("part").orderBy(*by_order)))
    firsts = dealt.groupBy("part").agg(F.min_by("key", F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])).alias("first"))
    line = Window.partitionBy(F.lit(0)).orderBy("part")
    turned = firsts.select("part", F.coalesce(F.lead("first").over(line), F.first_value("first").over(
        line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    return within.join(turned, "part").withColumn("next_key", F.coalesce("following", "after")).drop("part", "following", "after")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how like its own the edited and the next document's are.

    The edited text has its last floor(n / share) code points replaced by the first as many (or all) of the next
    document by id, that of the last being the first. Documents with an equal id follow each other by the MD5 of their
    text; rows equal in id and text are one document, and each gets its result. A null id comes first.

    The order is found on ids alone, and a document sends to the one before it only the characters and digests needed
    there, so whole texts are shuffled once.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    mine = docs.select(F.col(id_col).alias("id"), body.alias("text"), F.md5(F.concat(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), body)).alias("key"))
    keys = mine.select("id", "key", F.char_length("text").alias("n")).distinct()
    sent = next_keys(keys, ["id", "key"]).select(F.col("next_key").alias("key"), F.col("key").alias("to"),
                                                 F.floor(F.col("n") / share).cast("int").alias("k"))
    packed = lambda digests: F.unhex(F.array_join(F.transform(F.flatten(F.flatten(digests)), lambda d: F.substring(d, 1, SHORT)), ""))
    heads = mine.join(sent, "key").select(F.col("to").alias("key"), F.struct(
        F.substring(F.col("text"), F.lit(1), F.col("k")).alias("head"), packed(tree(F.col("text"))).alias("runs"),
        F.col("key").alias("from"), F.col("id").alias("from_id")).alias("next"))  # the id too: both joins then read one shuffle
    heads = heads.groupBy("key").agg(F.any_value("next").alias("next"))
    joined = mine.join(heads, "key").withColumn("n_chars", F.char_length("text").cast("long"))
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / share)).cast("int")
    whole = joined.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), kept), F.col("next.head")))
    trees = whole.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"),
                         fingerprint(F.col("edited")).alias("edited_fingerprint"),
                         F.regexp_extract_all(F.lower(F.hex("next.runs")), F.lit("[0-9a-f]{%d}" % SHORT), F.lit(0)).alias("next_runs"),
                         (F.col("key") == F.col("next.from")).alias("alone"))
    ours = trees.withColumn("runs", runs_of(F.col("fingerprint")))
    return ours.select("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       _likeness(F.col("runs"), F.col("next_runs"), F.col("alone") | (F.col("runs") == F.col("next_runs"))).alias("near_next"))

"""Regular-expression search, line by line, over a text column or a folder of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import lines, number_lines
from ..scratch import stage


def grep(df: DataFrame, pattern: str, id_column: str, text_column: str, limit: int | None = None) -> DataFrame:
    """`(id, line_no, line)` for each line that matches; lines count from 1 and are trimmed on the right.

    All matches by default. With `limit`, the first ones by id and line number.
    """
    found = (
        number_lines(df, [F.col(id_column).alias("__id")], F.col(text_column))
        .where(F.col("line").rlike(pattern))
        .select(
            F.col("__id").alias(id_column),
            (F.col("pos") + 1).cast("bigint").alias("line_no"),
            F.regexp_replace("line", r"\s+$", "").alias("line"),
        )
    )
    return found if limit is None else found.orderBy(id_column, "line_no").limit(limit)


def grep_files(spark: SparkSession, path: str, pattern: str, include: str | None = None,
               limit: int | None = None) -> DataFrame:
    """The same over the text files below `path`; `include` is a file name glob.

    A file is read in as many tasks as it has splits. One pass writes, for each line up to a line feed, its split, its
    running number and what matches in it; the lines of earlier splits, counted per split, turn places in a split into
    line numbers. Other line breaks inside such a line open lines too; one of them at the very end of a file opens an
    empty last line. Compressed files have one split.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    if include:
        reader = reader.option("pathGlobFilter", include)
    rows = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("running"),
        "value",
    )

    def hit(line: Column, pos: Column) -> Column:
        return F.struct(pos.alias("pos"), F.regexp_replace(line, r"\s+$", "").alias("line"))

    # nearly all lines hold no further line break
    several = F.col("value").rlike(fixed.LINE_BREAK)
    split = lines(F.concat("value", F.lit("\n")))
    every = F.filter(F.transform(split, lambda x, i: F.when(x.rlike(pattern), hit(x, i))), lambda x: x.isNotNull())
    hits = F.when(several, every).when(F.col("value").rlike(pattern), F.array(hit(F.col("value"), F.lit(0)))).otherwise(F.array())
    written = stage(rows.select("file", "block", "running", F.when(several, F.size(split)).otherwise(1).alias("n"), hits.alias("hits")), "file-lines")
    place = Window.partitionBy("file").orderBy("block")
    blocks = written.groupBy("file", "block").agg(F.min("running").alias("first"), F.sum("n").alias("total"))
    # one row per split
    blocks = stage(blocks.select("file", "block", "first", (F.sum("total").over(place) - F.col("total")).alias("before")), "file-splits")
    # lines that hold line breaks of other kinds push on those behind them in their split
    inside = Window.partitionBy("file", "block").orderBy("running").rowsBetween(Window.unboundedPreceding, -1)
    special = written.where((F.col("n") > 1) | (F.size("hits") > 0))
    pushed = special.withColumn("pushed", F.coalesce(F.sum(F.col("n") - 1).over(inside), F.lit(0))).where(F.size("hits") > 0)
    line_no = F.col("before") + F.col("running") - F.col("first") + F.col("pushed") + F.col("hit.pos") + 1
    found = (
        pushed.join(blocks, ["file", "block"])
        .withColumn("hit", F.explode("hits"))
        .select("file", line_no.cast("bigint").alias("line_no"), F.col("hit.line").alias("line"))
    )
    return found if limit is None else found.orderBy("file", "line_no").limit(limit)

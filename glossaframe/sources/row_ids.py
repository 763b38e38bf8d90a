"""The synthetic row key `_rid`: 1-based, gapless, in input order or in the order of given columns.

No plan here sorts the table in one task. Rows get their position inside a partition or file from a narrow
expression, the few per-partition counts are summed into offsets on the driver, and the offsets are joined
back from a table of proven size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stage

RID = "_rid"


def _position_in_partition() -> Column:
    """1-based place of a row in its partition: the low 33 bits of its running number."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1


def _add_offsets(numbered: DataFrame, counts: DataFrame, by: list[str], position: str) -> DataFrame:
    """`_rid` = rows in earlier blocks + position in the block. `counts` has one row per block."""
    order = Window.orderBy(*by)
    offsets = stage(
        counts.withColumn("__offset", F.sum("__n").over(order) - F.col("__n")).drop("__n"), "row-offsets"
    )
    # the window runs over one row per block, never over the data
    joined = numbered.join(offsets, by, "left")
    rid = (F.col("__offset") + F.col(position)).cast("bigint").alias(RID)
    keep = [c for c in numbered.columns if c not in (*by, position)]
    return joined.select(rid, *[F.col(f"`{c}`") for c in keep])


def number_parquet_rows(df: DataFrame) -> DataFrame:
    """Row key of a Parquet scan, in file name and row order. Moves no data: one pass counts rows per file."""
    keyed = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        (F.col("_metadata.row_index") + 1).alias("__position"),
    )
    counts = keyed.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    return _add_offsets(keyed, counts, ["__file"], "__position")


def number_text_rows(df: DataFrame, name: str = "rows") -> DataFrame:
    """Row key of a CSV or JSON scan, in file name and byte order.

    These formats carry no row index. The rows are written once as Parquet together with the file block they
    came from and their running number in the task; a block lies inside one task, so its smallest running
    number turns the rest into positions.
    """
    staged = stage(
        df.select(
            "*",
            F.col("_metadata.file_path").alias("__file"),
            F.col("_metadata.file_block_start").alias("__block"),
            F.monotonically_increasing_id().alias("__running"),
        ),
        name,
    )
    blocks = staged.groupBy("__file", "__block").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__running").alias("__first")
    )
    order = Window.orderBy("__file", "__block")
    offsets = stage(
        blocks.withColumn("__offset", F.sum("__n").over(order) - F.col("__n") - F.col("__first") + 1)
        .select("__file", "__block", "__offset"),
        "row-offsets",
    )
    rid = (F.col("__offset") + F.col("__running")).cast("bigint").alias(RID)
    return staged.join(offsets, ["__file", "__block"], "left").select(rid, *[F.col(f"`{c}`") for c in df.columns])


def number_rows_by(df: DataFrame, order_by: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Row key in the order of the given columns.

    Ties are broken by a hash of the whole row, then by the running number of the row, so that many equal
    rows are spread over partitions; equal rows are interchangeable, so the numbering stays well defined.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = [F.col(f"`{c}`") for c in order_by]
    sort = [*keys, F.col("__tie"), F.col("__running")]
    ranged = (
        df.withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
        .withColumn("__running", F.monotonically_increasing_id())
        .repartitionByRange(n, *sort)
        .sortWithinPartitions(*sort)
    )
    # written, because partition numbers must not change between counting and use
    written = stage(
        ranged.select(
            *[F.col(f"`{c}`") for c in df.columns],
            F.spark_partition_id().alias("__part"),
            _position_in_partition().alias("__position"),
        ),
        "ordered-rows",
    )
    counts = written.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    return _add_offsets(written, counts, ["__part"], "__position")


def number_rows(df: DataFrame) -> DataFrame:
    """Row key of any other frame, in its current partition order."""
    written = stage(
        df.select(
            "*",
            F.spark_partition_id().alias("__part"),
            _position_in_partition().alias("__position"),
        ),
        "numbered-rows",
    )
    counts = written.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    return _add_offsets(written, counts, ["__part"], "__position")

"""Tables in hash buckets of a key, so that joins and groupings by that key need no exchange.

A bucketed table is an entry of the session's catalog over files in a folder: the files carry their bucket's number, the
entry says by which column and into how many buckets the rows are dealt. The entry is made when the folder is opened, in
any session.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_buckets(df: DataFrame, path: str, key: str, n: int, partition_by: Sequence[str] = ()) -> None:
    """Write `df` below `path` in `n` buckets of `key`, one file for each bucket (and value of `partition_by`)."""
    writer = df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    name = f"glossaframe_{uuid.uuid4().hex}"
    writer.saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the entry only, the files are not Spark's to delete


def open_buckets(spark: SparkSession, path: str, schema: str, key: str, n: int, partition_by: Sequence[str] = ()) -> DataFrame:
    """The rows of what `write_buckets` has written at `path`, or, with `partition_by`, in several calls below it. The
    catalog keeps one entry for each path; each call looks for new files."""
    name, quoted = f"glossaframe_{hashlib.md5(f'{path} {n}'.encode()).hexdigest()}", path.replace("'", "\\'")
    parts = f"PARTITIONED BY ({', '.join(partition_by)}) " if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet {parts}CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS LOCATION '{quoted}'")
    if partition_by:
        spark.catalog.recoverPartitions(name)
    spark.catalog.refreshTable(name)
    return spark.table(name)

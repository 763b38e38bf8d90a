"""Written tables as barriers.

A frame that feeds several jobs, or whose rows cost money to compute, is written once as Parquet in the
shared folder named by `spark.checkpoint.dir` and read back. Unlike persisted blocks, the written table
survives the loss of executors, and Spark knows its true size when it later picks a join strategy.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a fresh temporary one only in local mode when unset."""
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_DIR, None) or context.getConf().get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="glossaframe-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` once and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of plans that nothing refers to any more. Python's frames in reference cycles hold
    on to theirs until Python's own garbage is collected, and Spark notices only when the driver's JVM collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

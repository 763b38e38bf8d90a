"""Binary files in the shared folder, written by tasks and read by tasks.

Spark has no writer for a binary format of one's own, so tasks open the files through `pyarrow.fs`, which reaches
local and mounted folders, HDFS and object stores by URI. Every task attempt writes a file of a new name and returns
that name as a row; a file counts only if its row was committed, so lost executors and repeated attempts do no harm.
"""

from __future__ import annotations

import uuid
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def _resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        raise ValueError(f"{uri} names no file system, so tasks cannot tell which one it is on")
    return fs.FileSystem.from_uri(uri)


def shared_folder(spark: SparkSession, folder: str) -> str:
    """The folder with its file system. One named without is on Hadoop's default file system, as Spark reads it, and not
    on each executor's own disk."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()


def create(folder: str, name: str, suffix: str) -> tuple[str, pa.NativeFile]:
    """A new file of a name that no other attempt has; its URI and an open stream."""
    uri = f"{folder}/{name}-{uuid.uuid4().hex[:12]}{suffix}"
    store, path = _resolve(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, store.open_output_stream(path)


def open_stream(uri: str) -> BinaryIO:
    """From start to end, in pieces."""
    store, path = _resolve(uri)
    return store.open_input_stream(path)


def open_random(uri: str) -> pa.NativeFile:
    """With seek and read_at."""
    store, path = _resolve(uri)
    return store.open_input_file(path)


def discard(staged: DataFrame) -> None:
    """Delete the files of a table that `stage` has written, once nothing will read it again."""
    context = staged.sparkSession.sparkContext
    for folder in {file.rpartition("/")[0] for file in staged.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

"""Loading files as frames with a row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .dialects import detect
from .row_ids import number_parquet_rows, number_rows_by, number_text_rows

FORMATS = {
    ".csv": "csv", ".tsv": "csv",
    ".parquet": "parquet", ".pq": "parquet",
    ".json": "json", ".jsonl": "json", ".ndjson": "json",
}


def suffix_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return "." + name.rsplit(".", 1)[1] if "." in name else ""


def read_file(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str | None = None,
              multiline: bool | None = None, sep: str | None = None, quote: str | None = None) -> DataFrame:
    """Read CSV, TSV, Parquet or JSON by suffix (`fmt` names the suffix for folders without one).

    Without `schema`, CSV and JSON types are inferred, which costs one more pass: give one for large inputs.
    `multiline` allows line breaks inside quoted CSV fields and JSON arrays, at the price of one task per file;
    set it to False for large CSV files known to hold one row per line. A malformed row is an error.
    The delimiter and quote of a CSV file without `sep` come from its first lines, see `dialects.detect`; `quote`
    alone is passed on. A `.tsv` file has tabs.
    """
    suffix = fmt or suffix_of(path)
    kind = FORMATS.get(suffix)
    if kind is None:
        raise ValueError(f"unsupported file type '{suffix}': use one of {sorted(FORMATS)}")
    reader = spark.read.option("mode", "FAILFAST") if kind != "parquet" else spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "csv":
        if schema is None:
            reader = reader.option("inferSchema", True)
        if sep is None and suffix == ".tsv":
            sep = "\t"
        if sep is None:
            found = detect(spark, path)
            sep, quote = found.sep, quote or found.quote
        quote = quote or '"'
        return (
            reader.option("header", True)
            .option("sep", sep)
            .option("quote", quote).option("escape", quote)
            .option("multiLine", True if multiline is None else multiline)
            .csv(path)
        )
    return reader.option("multiLine", suffix == ".json" if multiline is None else multiline).json(path)


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str | None = None,
         multiline: bool | None = None, order_by: Sequence[str] | None = None, sep: str | None = None,
         quote: str | None = None) -> DataFrame:
    """Read a file and add `_rid`, by input order or by the given columns."""
    df = read_file(spark, path, schema, fmt, multiline, sep, quote)
    if order_by:
        return number_rows_by(df, order_by)
    if FORMATS[fmt or suffix_of(path)] == "parquet":
        return number_parquet_rows(df)
    return number_text_rows(df)

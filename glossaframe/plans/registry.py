"""Named queries over the standard tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def same_sql(name: str, sql: str) -> None:
    """Register SQL text that Spark and other engines read alike."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        open_tables(spark, sf_dir)
        return spark.sql(sql)

    QUERIES[name], SQL[name] = build, sql


def path_of(sf_dir: str, table: str) -> str:
    return f"{sf_dir.rstrip('/')}/{table}.parquet"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(path_of(sf_dir, table))


def open_tables(spark: SparkSession, sf_dir: str) -> None:
    for table in TABLES:
        read(spark, sf_dir, table).createOrReplaceTempView(table)

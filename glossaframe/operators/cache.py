"""The memo of judgements: a Parquet dataset of batches and a small log of what happened to it.

Layout below the root: `data/batch_id=<n>-<random>/table_name=<t>/column_name=<c>/` holds one batch per run, and
`log/` one JSON row per change, which names its batch. A batch counts only once its log row is written, and no two
runs use the same folder, so a crash leaves the former state readable and writable. Deleting adds a log row with the filter and touches no data until `compact`.
One writer at a time; any number of readers.

The files of a batch are buckets of the key, as many in all batches, so a lookup shuffles the keys that are asked for and
nothing of the memo.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..buckets import open_buckets, write_buckets
from ..functions import fixed
from .skew import fan_out

ENTRY_SCHEMA = (
    "cache_key string, row_key string, value string, model string, tool_name string, goal string, "
    "schema_hash string, prompt_preview string, source_columns string, created_at timestamp, "
    "batch_id string, table_name string, column_name string"
)
ENTRY_COLUMNS = [field.split()[0] for field in ENTRY_SCHEMA.split(", ")]
LOG_SCHEMA = "version bigint, action string, filters string, batch string, buckets int"
PARTITIONS = ["table_name", "column_name"]
FILTERS = ("table_name", "column_name", "tool_name", "goal", "model")
GROUP = ["table_name", "column_name", "tool_name", "goal", "model", "schema_hash", "source_columns"]


def _matches(filters: dict[str, str]) -> Column:
    tests = [F.col(name) == F.lit(value) for name, value in filters.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _filters(table=None, column=None, tool_name=None, goal=None, model=None) -> dict[str, str]:
    """Empty text means no filter."""
    given = dict(zip(FILTERS, (table, column, tool_name, goal, model)))
    return {name: value for name, value in given.items() if value}


class JudgementCache:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        """`buckets` is how many files a batch has, as many as a shuffle has partitions if not given; a memo keeps the number
        it was first written with."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets or fan_out(spark)

    # ---- the log: one row per run, read on the driver -----------------------------------------------------

    def _log(self) -> list:
        try:
            return self.spark.read.schema(LOG_SCHEMA).json(f"{self.root}/log").orderBy("version").collect()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":  # nothing written yet; anything else must not look like that
                return []
            raise

    def _commit(self, version: int, action: str, filters: dict | None = None, batch: str | None = None, buckets: int | None = None) -> None:
        row = [(version, action, json.dumps(filters or {}), batch, buckets)]
        self.spark.createDataFrame(row, LOG_SCHEMA).coalesce(1).write.mode("append").json(f"{self.root}/log")

    def _next_version(self) -> int:
        return max((r["version"] for r in self._log()), default=0) + 1

    @staticmethod
    def _batch(version: int) -> str:
        """Sorts after all batches of lower versions; no other run makes the same."""
        return f"{version:010d}-{uuid.uuid4().hex[:12]}"

    # ---- reading ------------------------------------------------------------------------------------------

    def _live(self, table: str | None = None) -> tuple[DataFrame | None, int]:
        """Entries that are not deleted, of all batches, in buckets of the key where all batches have them alike; and the
        number of batches. A key holds the table name but not the column name or goal: only the table may be cut before
        the latest entry of each key is known."""
        log = self._log()
        start = max((r["version"] for r in log if r["action"] == "replace"), default=0)
        added = [r for r in log if r["action"] in ("add", "replace") and r["version"] >= start]
        if not added:
            return None, 0
        batches = [r["batch"] or f"{r['version']:010d}" for r in added]
        data, numbers = f"{self.root}/data", {r["buckets"] for r in added}
        if len(numbers) == 1 and None not in numbers:
            live = open_buckets(self.spark, data, ENTRY_SCHEMA, "cache_key", numbers.pop(), ["batch_id", *PARTITIONS])
            live = live.where(F.col("batch_id").isin(batches))
        else:
            live = self.spark.read.schema(ENTRY_SCHEMA).option("basePath", data).parquet(*[f"{data}/batch_id={batch}" for batch in batches])
        if table:
            live = live.where(F.col("table_name") == F.lit(table))
        for row in log:
            if row["action"] == "delete" and row["version"] > start:
                gone = (F.col("batch_id") < F.lit(f"{row['version']:010d}")) & _matches(json.loads(row["filters"]))
                live = live.where(~gone)
        return live, len(batches)

    def entries(self, **filters) -> DataFrame:
        """Live entries, the latest per key. Takes the filters of `status`."""
        wanted = _filters(**filters)
        live, batches = self._live(wanted.get("table_name"))
        if live is None:
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        if batches > 1:  # keys are unique inside a batch
            others = [c for c in ENTRY_COLUMNS if c != "cache_key"]
            live = live.groupBy("cache_key").agg(F.max_by(F.struct(*others), "batch_id").alias("e")).select("cache_key", "e.*")
        return live.where(_matches(wanted)).select(*ENTRY_COLUMNS)

    def is_empty(self) -> bool:
        return not any(r["action"] == "add" for r in self._log())

    def values(self, table: str | None, wanted: DataFrame | None = None) -> DataFrame:
        """`(cache_key, value_json)` for lookups, of the keys in `wanted` if given; bad or null JSON counts as absent.

        Entries of other keys are left out before the latest of each key is chosen, and only values are carried along."""
        live, batches = self._live(table)
        if live is None:
            return self.spark.createDataFrame([], "cache_key string, value_json string")
        narrow = live.select("cache_key", "value", "batch_id")
        if wanted is not None:
            narrow = narrow.join(wanted.select("cache_key"), "cache_key", "left_semi")
        if batches > 1:
            narrow = narrow.groupBy("cache_key").agg(F.max_by("value", "batch_id").alias("value"))
        return narrow.select("cache_key", F.to_json(F.try_parse_json("value")).alias("value_json")).where(
            F.col("value_json").isNotNull() & (F.col("value_json") != "null"))

    def count(self, table: str, column: str) -> int:
        return self.entries(table=table, column=column).count()

    def status(self, table: str | None = None, column: str | None = None, tool_name: str | None = None,
               goal: str | None = None, model: str | None = None, limit: int | None = None) -> DataFrame:
        """Entries per table, column, tool, goal, model, schema and sources; the largest groups first."""
        grouped = (
            self.entries(table=table, column=column, tool_name=tool_name, goal=goal, model=model)
            .groupBy(*GROUP)
            .agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("created_min"), F.max("created_at").alias("created_max"))
            .orderBy(F.desc("n"), F.desc("created_max"), *GROUP)
        )
        return grouped if limit is None else grouped.limit(limit)

    # ---- writing ------------------------------------------------------------------------------------------

    def _write(self, batch: DataFrame, version: int, action: str) -> None:
        buckets = next((r["buckets"] for r in reversed(self._log()) if r["buckets"]), self.buckets)
        name = self._batch(version)
        write_buckets(batch, f"{self.root}/data/batch_id={name}", "cache_key", buckets, PARTITIONS)
        self._commit(version, action, batch=name, buckets=buckets)

    def put(self, judgements: DataFrame, table: str, column: str, model: str, tool_name: str, goal: str,
            schema_hash: str, prompt_preview: Column | str, source_columns: str) -> None:
        """Append `(cache_key, row_key, value)`, one row per key. Rows without a value are not kept."""
        if not table or not column:
            raise ValueError("cached judgements need a table and a column name")
        version = self._next_version()
        preview = F.lit(prompt_preview) if isinstance(prompt_preview, str) else prompt_preview
        batch = judgements.where(F.col("value").isNotNull()).select(
            "cache_key", F.col("row_key").cast("string").alias("row_key"), "value",
            F.lit(model).alias("model"), F.lit(tool_name).alias("tool_name"), F.lit(goal).alias("goal"),
            F.lit(schema_hash).alias("schema_hash"),
            F.substring(preview, 1, fixed.PROMPT_PREVIEW_CHARS).alias("prompt_preview"),
            F.lit(source_columns).alias("source_columns"), F.current_timestamp().alias("created_at"),
            F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
        )
        self._write(batch, version, "add")

    def delete(self, table: str | None = None, column: str | None = None, tool_name: str | None = None,
               goal: str | None = None, model: str | None = None, all_entries: bool = False) -> int:
        """Forget matching entries and return how many there were."""
        filters = _filters(table, column, tool_name, goal, model)
        if not filters and not all_entries:
            raise ValueError("no filter given: pass all_entries=True to delete everything")
        n = self.entries(table=table, column=column, tool_name=tool_name, goal=goal, model=model).count()
        if n:
            self._commit(self._next_version(), "delete", filters)
        return n

    def compact(self) -> None:
        """Rewrite the live entries as a single batch."""
        self._write(self.entries().drop("batch_id"), self._next_version(), "replace")

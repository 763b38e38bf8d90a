"""Enriching new rows as they arrive.

The memo is the only state: each micro-batch goes through the same operator as a full table, so content seen
before is answered from the memo. Rows must carry a `_rid` of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.enrich import Enrichment


def enrich_stream(stream: DataFrame, operator: Callable[[DataFrame], Enrichment], output_path: str,
                  checkpoint_path: str) -> StreamingQuery:
    """Run `operator` on each micro-batch and write the enriched rows below `output_path`, one folder per batch.

    A batch that is repeated after a failure overwrites its own folder.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        operator(batch).df.write.mode("overwrite").parquet(f"{output_path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )

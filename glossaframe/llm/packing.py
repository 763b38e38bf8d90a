"""Packing of documents into training sequences by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many of the longest length as fit, then one for
each binary digit of the rest. Pieces of equal length make sequences of that length, so no sequence holds two
documents and none is padded. Sequences are numbered length by length, longest first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stage
from .encode import text_encoder

LONGEST = 4096
END_ID = 2


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of `n` ids, in order; `longest` must be a power of two."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in reversed(range(longest.bit_length() - 1)) if rest >> k & 1]


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of every row's whole text.

    `start` is the piece's place in its document, `offset` its place in its sequence, always 0. Every document ends
    with `end_id`, so a null or empty text has one piece of one id. Repeated rows have pieces of their own. An empty
    table has no pieces.

    Tasks number their pieces per length; what comes before each task and length is added up from one row for each of
    these. Texts are not shuffled.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError(f"longest must be a power of two, not {longest}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = text_encoder(tokenizer_path)
        part, made = TaskContext.get().partitionId(), dict.fromkeys((1 << k for k in range(longest.bit_length())), 0)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows, row_of = [], []
            for place, packed in enumerate(encoder.encode(batch.column(1).to_pylist())):
                packed += end
                total, start = len(packed) // 4, 0
                for length in piece_lengths(total, longest):
                    rows.append((start, length, zlib.crc32(packed[4 * start: 4 * (start + length)]), total, made[length]))
                    row_of.append(place)
                    made[length] += 1
                    start += length
            columns = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row_of, pa.int64())), *map(pa.array, columns),
                                              pa.array([part] * len(rows), pa.int32())], names)

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "nth", "part"]
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    pieces = stage(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, nth bigint, part int"), "pieces")
    counts = pieces.groupBy("length", "part").count()
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("length").desc(), "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return pieces.join(bases, ["length", "part"]).select("id", "start", "length", "ids_crc32", "doc_tokens",
                                                         (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

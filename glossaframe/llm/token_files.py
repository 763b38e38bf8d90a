"""Token ids in binary files of fixed-width bits, with random access.

A file holds the ids of consecutive documents as one stream, cut into blocks of BLOCK ids. Every id takes the same
number of bits, the least that the vocabulary needs; a block starts at a whole byte, and the file ends with the
blocks' offsets, their number, the number of ids, the bits and a mark. Any id is found by its position alone: its block
by division, its bits by multiplication, and a block is unpacked with a few numpy operations.

Documents are dealt to files by range of id, so the files in order hold the documents in order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import new_path, stage
from .encode import text_encoder
from .files import create, open_random, shared_folder

BLOCK = 1 << 16
MARK = b"FWTOKEN1"
END_ID = 2


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive little-endian bit fields, filled up to a whole byte. Ids that need more bits are refused."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits % 8 == 0:
        return ids.view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    fields = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(fields, bitorder="little").tobytes()


def unpack(packed: bytes, bits: int, n: int) -> np.ndarray:
    """The first `n` ids of a packed block: each field lies within 8 bytes from its first, read and shifted at once."""
    padded = np.frombuffer(bytes(packed) + bytes(8), np.uint8)
    at = np.arange(n, dtype=np.int64) * bits
    words = np.zeros(n, "<u8")
    for k in range((bits + 14) // 8):
        words |= padded[(at >> 3) + k].astype("<u8") << np.uint64(8 * k)
    return ((words >> (at & 7).astype("<u8")) & np.uint64((1 << bits) - 1)).astype("<u4")


class TokenFileWriter:
    """Appends ids; holds at most one block in memory beside what is appended."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits, self.waiting, self.offsets, self.at, self.n_ids = stream, bits, [], [], 0, 0
        self.n_waiting = 0

    def _put(self, ids: np.ndarray) -> None:
        packed = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.at += len(packed)
        self.stream.write(packed)

    def append(self, ids: np.ndarray) -> int:
        """The position of the first of these ids in the file."""
        start, self.n_ids = self.n_ids, self.n_ids + len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            together = np.concatenate(self.waiting)
            whole = len(together) // BLOCK * BLOCK
            for low in range(0, whole, BLOCK):
                self._put(together[low: low + BLOCK])
            self.waiting, self.n_waiting = [together[whole:].copy()], len(together) - whole
        return start

    def close(self) -> None:
        if self.n_waiting:
            self._put(np.concatenate(self.waiting))
        tail = np.array([*self.offsets, len(self.offsets), self.n_ids, self.bits], "<u8")
        self.stream.write(tail.tobytes() + MARK)
        self.stream.close()


class TokenFileReader:
    """Ids by position. Keeps the block it read last."""

    def __init__(self, file):
        self.file, size = file, file.size()
        n_blocks, self.n_ids, self.bits = np.frombuffer(file.read_at(24, size - 24 - len(MARK)), "<u8").astype(int).tolist()
        if file.read_at(len(MARK), size - len(MARK)) != MARK:
            raise ValueError("not a token file, or cut off")
        tail = size - 24 - len(MARK) - 8 * n_blocks
        self.offsets = [*np.frombuffer(file.read_at(8 * n_blocks, tail), "<u8").astype(int).tolist(), tail]
        self.block, self.ids = -1, np.zeros(0, "<u4")

    def _block(self, k: int) -> np.ndarray:
        if k != self.block:
            n = min(BLOCK, self.n_ids - k * BLOCK)
            self.block, self.ids = k, unpack(self.file.read_at(self.offsets[k + 1] - self.offsets[k], self.offsets[k]), self.bits, n)
        return self.ids

    def read(self, start: int, n: int) -> np.ndarray:
        parts = []
        while n:
            inside = start % BLOCK
            parts.append(self._block(start // BLOCK)[inside: inside + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def write_token_files(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID) -> DataFrame:
    """Encode every row's whole text, append `end_id`, write the files, and return the written table of documents:
    (id, path, part, seq, at, n_tokens), `at` being the position in the file.

    Documents are in order of id over the files and in each file. Rows with an equal id are in the order of their
    texts; a null id comes first, a null text is an empty one. An empty table makes no file.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, new_path(spark, "token-files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = text_encoder(tokenizer_path)
        end, writer, path, seq = np.array([end_id], "<u4"), None, "", 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            if writer is None and batch.num_rows:
                path, stream = create(folder, f"part-{part:06d}", ".tok")
                writer = TokenFileWriter(stream, bits_for(max(encoder.vocabulary, end_id + 1)))
            lengths, places = [], []
            for packed in encoder.encode(batch.column(1).to_pylist()):
                ids = np.append(np.frombuffer(packed, "<u4"), end)
                places.append(writer.append(ids))
                lengths.append(len(ids))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([path] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64()),
                pa.array(places, pa.int64()), pa.array(lengths, pa.int64())], ["id", "path", "part", "seq", "at", "n_tokens"])
            seq += n
        if writer is not None:
            writer.close()

    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()
    ordered = narrow.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    return stage(ordered.mapInArrow(run, f"id {id_type}, path string, part int, seq bigint, at bigint, n_tokens bigint"), "token-index")


def with_starts(index: DataFrame) -> DataFrame:
    """The table of documents with `start`, the number of ids of all documents before. Only one row for each file is
    brought together to add up."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return index.join(bases, "part").withColumn("start", F.col("base") + F.col("at"))


def read_token_files(index: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) from a table of documents with starts: ids are read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, reader = None, None
        for batch in batches:
            sums = []
            for path, at, n in zip(*(batch.column(k).to_pylist() for k in (3, 4, 2))):
                if path != opened:
                    opened, reader = path, TokenFileReader(open_random(path))
                sums.append(zlib.crc32(reader.read(at, n).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())],
                                             ["id", "start", "n_tokens", "ids_crc32"])

    id_type = index.schema["id"].dataType.simpleString()
    return index.select("id", "start", "n_tokens", "path", "at").mapInArrow(
        run, f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")

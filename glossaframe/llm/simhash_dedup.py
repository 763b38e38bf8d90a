"""Near-duplicate documents by SimHash, with covering locality-sensitive hashing.

A document's fingerprint has a bit set where more than half of its shingle hashes have it set. Two fingerprints are
linked at a small Hamming distance. Each table of the index keeps the bits of one structured mask: bit i is given a
non-zero vector m(i) of radius + 1 bits, and the mask of a vector v holds the bits with odd <m(i), v>. Any `radius`
vectors m(i) leave some v orthogonal to all of them, so every pair within the radius agrees on the whole of some mask
and meets in that table for certain.

Pairs inside a bucket are never listed. A table's bucket only tells which fingerprints have company, and in which bits
they may differ (those outside the mask). Two fingerprints within two bits of each other, and only those, reach a
common point by turning at most one bit each, so every fingerprint with company sends itself and its one-bit
neighbours in those bits to a group-by. A point gathers at most 65 fingerprints whatever the size of the bucket, all
of them within two bits of each other, and they are linked to the smallest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stage
from .components import components

BITS = 64
SEED = 42
RADIUS = 2
WIDTH = 3
# shingles whose bits are counted at a time, so that a long text needs no more memory than a short one
COUNTED_AT_ONCE = 1 << 15


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering masks as unsigned integers, 2^(radius+1) - 1 of them."""
    vectors = (1 << (radius + 1)) - 1
    assigned = [1 + i % vectors for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(assigned) if (m & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint as a signed 64-bit integer; 0 without words, the hash of all words if they are under `width`."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both are ASCII-only on bytes
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    if len(words) < width:
        spans = [(0, len(joined))]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        spans = list(zip((ends - lengths)[: len(words) - width + 1].tolist(), ends[width - 1:].tolist()))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in spans[low: low + COUNTED_AT_ONCE]], "<u8")
                    for low in range(0, len(spans), COUNTED_AT_ONCE))


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that more than half of the hashes (little-endian uint64) have set, as a signed 64-bit integer."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in parts:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([simhash(t, width) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["id", "fp"])

    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, fp bigint")


def near_links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """(fp, hub): links between distinct fingerprints at most two bits apart. Their components are those of all
    pairs within two bits."""
    chosen = masks()
    tables = distinct.select(fp, F.explode(F.array(*[
        F.struct(F.lit(t).alias("table"), F.col(fp).bitwiseAND(F.lit(_signed(mask))).alias("key"), F.lit(_signed(~mask % (1 << 64))).alias("free"))
        for t, mask in enumerate(chosen)])).alias("x")).select(fp, "x.table", "x.key", "x.free")
    shared = tables.groupBy("table", "key").count().where(F.col("count") > 1).select("table", "key")
    company = tables.join(shared, ["table", "key"], "left_semi").groupBy(fp).agg(F.bit_or("free").alias("free"))
    bit = F.array(*[F.lit(_signed(1 << i)) for i in range(BITS)])
    turned = F.transform(F.filter(bit, lambda b: F.col("free").bitwiseAND(b) != 0), lambda b: F.col(fp).bitwiseXOR(b))
    points = company.select(fp, F.explode(F.concat(F.array(F.col(fp)), turned)).alias("point"))
    # a point has at most 65 fingerprints within one bit, so this list is bounded
    met = points.groupBy("point").agg(F.collect_list(fp).alias("met")).where(F.size("met") > 1)
    return met.select(F.array_min("met").alias("hub"), F.explode("met").alias(fp)).where(F.col(fp) != F.col("hub")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id, root): each row with its fingerprint, the smallest id that links reach from it, and the
    smallest fingerprint they reach.

    Texts without a word have fingerprint 0 and are linked like any others. Rows with a null id belong to the group of
    their text; they never name a group, and a group of null ids only has a null component_id.
    """
    prints = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    firsts = stage(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    roots = components(near_links(firsts.select("fp")), "fp", "hub").withColumnRenamed("node", "fp")
    rooted = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id", "root")
    return prints.join(by_print, "fp").select("id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row of each group: that of the group's smallest id.

    Of rows that repeat this id any one stays. Rows with a null id stay only where their whole group has none, and
    then one row of the group's smallest fingerprint.
    """
    found = near_duplicates(docs, id_col, text_col)
    named = found.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("__kept")).distinct()
    kept = docs.where(F.col(id_col).isNotNull()).join(named, F.col(id_col) == F.col("__kept"), "left_semi").dropDuplicates([id_col])
    nameless = found.where(F.col("component_id").isNull()).select(F.col("root").alias("__kept")).distinct()
    without = docs.where(F.col(id_col).isNull()).withColumn("__fp", _simhash_column()(F.col(text_col)))
    lone = without.join(nameless, F.col("__fp") == F.col("__kept"), "left_semi").dropDuplicates(["__fp"]).drop("__fp")
    return kept.unionByName(lone)


def _simhash_column():
    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: simhash(t, WIDTH))

    return of

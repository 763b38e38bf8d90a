"""Byte-level BPE with ranked merges as Spark higher-order functions, and its decoding.

A text is cut by the vocabulary's pattern; each distinct piece is an array of bytes, and a fold applies one merge at a
time: of all neighbours the pair of the lowest rank, of equals the leftmost, until no pair has a rank.

The ranks are literals of the plan. A map literal would be searched from its start for every pair, so the map from
pairs of tokens to ranks is laid out as two hash tables in which each pair has one place in either (cuckoo hashing).
They come as session variables, which the optimizer turns into literals; spelled out as expressions they would make a
plan of many thousand nodes.

Pieces that are frequent in the corpus are encoded once and sent to all tasks, MOST_SENT of them at most; each other
piece is encoded in its document, once for each document.
"""

from __future__ import annotations

import base64
import uuid
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import stage
from .encode import distinct_led_by_space
from .expressions import let
from .worker import worker_local

# bounds of what is sent to every task: pieces, and bytes of a piece
MOST_SENT = 1 << 20
LONGEST_SENT = 64
# distinct pieces that a task counts before it hands the counts on
MOST_COUNTED = 1 << 19
FREE = 1 << 62  # in free places of the tables; no pair is marked so
NO_RANK = 1 << 16
PLACES = (299993, 299977)  # of either table, prime
END = 65535  # stands before and after a piece; no token has this rank
UNKNOWN = 1 << 31  # ids from here on are places of pieces that the sent ones lack


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of base64 tokens with ranks, one of each in a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def rank_tables(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Two tables: the rank of the token made of `left` and `right` is the low 16 bits of an entry whose other bits are
    left << 32 | right << 16, which stands at these bits modulo the table's size, in one of the tables."""
    if max(ranks.values()) >= END:
        raise ValueError(f"ranks from {END} on do not fit the tables")
    tables = [[FREE] * size for size in PLACES]
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is None or right is None:
                continue
            entry, side = left << 32 | right << 16 | rank, 0
            for _ in range(1000):  # whatever stands there moves to its place in the other table
                place = (entry >> 16 << 16) % PLACES[side]
                entry, tables[side][place] = tables[side][place], entry
                if entry == FREE:
                    break
                side = 1 - side
            else:
                raise ValueError("the vocabulary has too many pairs for the tables")
    return np.array(tables[0]), np.array(tables[1])


class RankLiterals:
    """The ranks as literals for expressions of one session."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        first, second = rank_tables(ranks)
        of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pair = [[ranks.get(bytes([a, b]), NO_RANK) << 16 | ranks[bytes([a])] for b in range(256)] for a in range(256)]
        values = {"first": first, "second": second, "of_byte": of_byte, "of_two": np.array(pair, np.int64).reshape(-1)}
        name = f"bpe_{uuid.uuid4().hex[:8]}"
        spark.createDataFrame(pa.table({k: pa.array([v], pa.list_(pa.int64())) for k, v in values.items()})).createOrReplaceTempView(name)
        for key in values:
            spark.sql(f"DECLARE OR REPLACE VARIABLE {name}_{key} ARRAY<BIGINT>")
            spark.sql(f"SET VAR {name}_{key} = (SELECT {key} FROM {name})")
        spark.catalog.dropTempView(name)
        self.first, self.second, self.of_byte, self.of_two = (F.expr(f"system.session.{name}_{key}") for key in values)

    def entry(self, left: Column, right: Column) -> Column:
        """What the fold keeps for a token: the rank of it and its right neighbour, and below that, the token."""
        key = F.shiftleft(left, 32).bitwiseOR(F.shiftleft(right, 16))
        ranks = [F.get(table, (key % F.lit(size)).cast("int")).bitwiseXOR(key) for table, size in zip((self.first, self.second), PLACES)]
        return F.shiftleft(F.least(*ranks, F.lit(NO_RANK).cast("long")), 16).bitwiseOR(left)


def merged(piece: Column, literals: RankLiterals) -> Column:
    """The ids of a piece given as an array of bytes (0 to 255). An empty or null piece has no ids.

    The fold's state has an entry for each token, with the rank of the pair that begins there above the token's own
    id, so the least entry's pair is next. A merge replaces two entries and renews the one before. Entries without a
    rank are above all others; a token at either end has the rank of no pair.
    """
    end = F.lit(END).cast("long")
    none = F.lit(NO_RANK << 16).cast("long")
    n = F.size(piece)
    inner = F.zip_with(F.slice(piece, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(piece, F.lit(2), n),
                       lambda a, b: F.get(literals.of_two, a.cast("int") * 256 + b))
    last = none.bitwiseOR(F.get(literals.of_byte, F.element_at(piece, -1).cast("int")))
    edge = none.bitwiseOR(end)
    start = F.concat(F.array(edge), inner, F.array(last, edge))

    def step(state: Column, _: Column) -> Column:
        def at(k: Column) -> Column:
            rank = F.shiftright(F.get(state, k - 1), 16)
            before, after = F.get(state, k - 2).bitwiseAND(END), F.get(state, k + 1).bitwiseAND(END)
            new = F.concat(F.slice(state, F.lit(1), k - 2), F.array(literals.entry(before, rank), literals.entry(rank, after)),
                           F.slice(state, k + 2, F.size(state)))
            return F.when(rank < END, new).otherwise(state)

        return let(F.array_position(state, F.array_min(state)).cast("int"), at)

    ids = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step,
                      lambda state: F.transform(F.slice(state, F.lit(2), F.size(state) - 2), lambda e: e.bitwiseAND(END).cast("int")))
    return F.when(n > 0, ids).otherwise(F.array().cast("array<int>"))


def pieces_of(stretch: str, find) -> list[str]:
    """The pattern's matches. A word, or a space and a word, is one match of any pattern that takes letters together, and a
    comma or full stop after it another one."""
    word = stretch[1:] if stretch[:1] == " " else stretch
    if word.isalpha():
        return [stretch]
    return [stretch[:-1], word[-1]] if word[-1:] in (",", ".") and word[:-1].isalpha() else find(stretch)


def piece_counts(docs: DataFrame, text_col: str, pattern: str) -> DataFrame:
    """(piece, n): how often each distinct piece of at most LONGEST_SENT bytes occurs, over all texts.

    The pattern must let a space go with what follows it and nothing else, as the usual byte-level ones do, so that
    texts can be cut before such spaces and each distinct stretch matched once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, stretches = regex.compile(pattern).findall, {}

        def handed_on():
            found: dict[str, int] = {}
            for stretch, n in stretches.items():
                for piece in pieces_of(stretch, find):
                    found[piece] = found.get(piece, 0) + n
            stretches.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["piece", "n"])

        for batch in batches:
            distinct, places = distinct_led_by_space(batch.column(0).to_pylist())
            for stretch, n in zip(distinct, np.bincount(np.concatenate(places), minlength=len(distinct)).tolist() if places else []):
                stretches[stretch] = stretches.get(stretch, 0) + n
            if len(stretches) >= MOST_COUNTED:
                yield handed_on()
        if stretches:
            yield handed_on()

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "piece string, n bigint")
    return counted.where(F.octet_length("piece") <= LONGEST_SENT).groupBy("piece").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """The pieces of the highest counts, whole classes of counts only, so that they are at most `most`."""
    level = F.floor(F.log2("n") * 16)
    classes = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # at most 16 * 63 rows
    total, least = 0, None
    for row in classes:
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    return counts.where(level >= least) if least is not None else counts.limit(0)


def byte_arrays(pieces: list[str]) -> pa.Array:
    """UTF-8 bytes of each piece, as numbers from 0 to 255."""
    data = [p.encode("utf-8", "surrogatepass") for p in pieces]
    offsets = np.zeros(len(data) + 1, np.int32)
    np.cumsum([len(d) for d in data], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(data), np.uint8).astype(np.int16)))


class SentPieces:
    """Ids of frequent pieces in a few arrays: sorted hashes, and the bytes and ids they stand for."""

    def __init__(self, hashes: np.ndarray, data: bytes, ends: array, ids: bytes, id_ends: array):
        self.hashes, self.data, self.ends, self.ids, self.id_ends = hashes, data, ends, ids, id_ends

    @classmethod
    def parts(cls, pieces: list[str], ids: list[bytes]) -> tuple:
        """What `__init__` takes. A broadcast holds these and no instance: its class need not be known on the executors."""
        hashes = np.array([cls._hash(p.encode()) for p in pieces], np.uint64)
        order = np.argsort(hashes, kind="stable")
        data = [pieces[i].encode() for i in order]
        # arrays of the array module: small, and their items are plain integers
        return (hashes[order], b"".join(data), array("q", np.cumsum([0, *map(len, data)]).tobytes()),
                b"".join(ids[i] for i in order), array("q", np.cumsum([0, *(len(ids[i]) for i in order)]).tobytes()))

    @staticmethod
    def _hash(data: bytes) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(data)

    def find(self, pieces: list[str]) -> list[bytes | None]:
        """Each piece's ids, None for one that is not here. Equal hashes are told apart by their bytes."""
        import xxhash

        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, data), np.uint64, len(data))
        at = np.searchsorted(self.hashes, wanted)
        here = np.zeros(len(data), bool) if not len(self.hashes) else self.hashes[np.minimum(at, len(self.hashes) - 1)] == wanted
        found: list[bytes | None] = [None] * len(data)
        for i, k in zip(np.flatnonzero(here).tolist(), at[here].tolist()):
            while k < len(self.hashes) and self.hashes[k] == wanted[i]:
                if self.data[self.ends[k]: self.ends[k + 1]] == data[i]:
                    found[i] = self.ids[self.id_ends[k]: self.id_ends[k + 1]]
                    break
                k += 1
        return found


def _sent(frequent: DataFrame, literals: RankLiterals) -> tuple:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), byte_arrays(batch.column(0).to_pylist())], ["piece", "bytes"])

    cut = frequent.select("piece").mapInArrow(run, "piece string, bytes array<smallint>")
    table = cut.select("piece", merged(F.col("bytes"), literals).alias("ids")).toArrow()  # at most MOST_SENT rows
    pieces, flat = [], []
    for chunk in table.to_batches():
        pieces += chunk.column(0).to_pylist()
        ids, ends = chunk.column(1).flatten().to_numpy().astype("<u4").tobytes(), chunk.column(1).offsets.to_numpy()
        ends = (ends - ends[0]) * 4
        flat += [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return SentPieces.parts(pieces, flat)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     decode: bool = False, most_sent: int = MOST_SENT) -> DataFrame:
    """(id, ids) for every row's whole text: the ids as little-endian unsigned 32-bit integers in one binary value; with
    `decode`, also `decoded`, the bytes that these ids stand for. A null or empty text has no ids.

    Texts are read twice and never shuffled. The ranks file must be on every node.
    """
    spark = docs.sparkSession
    literals = RankLiterals(spark, read_ranks(ranks_path))
    counts = stage(piece_counts(docs, text_col, pattern), "piece-counts")
    sent = spark.sparkContext.broadcast(_sent(most_frequent(counts, most_sent), literals))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, memo, older = regex.compile(pattern).findall, {}, {}
        known_pieces = SentPieces(*sent.value)
        for batch in batches:
            distinct, places = distinct_led_by_space(batch.column(1).to_pylist())
            found = list(map(memo.get, distinct))
            gaps = [k for k, ids in enumerate(found) if ids is None]
            new = [distinct[k] for k in gaps]
            values = {s: older[s] for s in new if s in older}
            memo.update(values)
            cuts = {s: pieces_of(s, find) for s in new if s not in values}
            pieces = list(set(chain.from_iterable(cuts.values())))
            known, lacking = dict(zip(pieces, known_pieces.find(pieces))), {}
            for piece, ids in known.items():
                if ids is None:  # its place among the lacking ones of this batch stands for it
                    known[piece] = (UNKNOWN + lacking.setdefault(piece, len(lacking))).to_bytes(4, "little")
            none_lacks = lacking.keys().isdisjoint
            for s, parts in cuts.items():
                values[s] = ids = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])
                if none_lacks(parts):
                    memo[s] = ids
            for k in gaps:
                found[k] = values[distinct[k]]
            if len(memo) > MOST_COUNTED // 2:  # what is used again comes back from the older ones
                memo, older = {}, memo
            names, ready, rare = list(lacking), [], []
            for own in places:
                packed = b"".join(map(found.__getitem__, own.tolist()))
                ids = np.frombuffer(packed, "<u4")
                at = np.flatnonzero(ids >= UNKNOWN)
                which, places = np.unique(ids[at], return_inverse=True)
                if len(at):
                    ids = ids.copy()
                    ids[at] = places + UNKNOWN
                    packed = ids.tobytes()
                ready.append(packed)
                rare.append([names[k - UNKNOWN] for k in which.tolist()])
            ends = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ready, pa.binary()), pa.ListArray.from_arrays(
                ends, byte_arrays([p for some in rare for p in some]))], ["id", "ids", "rare"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tokens() -> np.ndarray:
            ranks = read_ranks(ranks_path)
            table = np.full(max(ranks.values()) + 1, b"", object)
            for token, rank in ranks.items():
                table[rank] = token
            return table

        of_id = worker_local(("tokens", ranks_path), tokens) if decode else None
        for batch in batches:
            whole = []
            for packed, rare in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids = np.frombuffer(packed, "<u4")
                if rare:
                    at = np.flatnonzero(ids >= UNKNOWN)
                    which = (ids[at] - UNKNOWN).tolist()
                    sizes = np.ones(len(ids), np.int64)
                    sizes[at] = [len(rare[k]) for k in which]
                    starts = np.cumsum(sizes) - sizes
                    ids = np.repeat(ids, sizes)
                    for start, k in zip(starts[at].tolist(), which):
                        ids[start: start + len(rare[k])] = rare[k]
                whole.append(ids)
            columns = [batch.column(0), pa.array([i.astype("<u4").tobytes() for i in whole], pa.binary())]
            if decode:
                columns.append(pa.array([b"".join(of_id[i].tolist()) for i in whole], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        cut, f"id {id_type}, ids binary, rare array<array<smallint>>")
    encoded = marked.select("id", "ids", F.transform("rare", lambda piece: merged(piece, literals)).alias("rare"))
    return encoded.mapInArrow(filled, f"id {id_type}, ids binary" + ", decoded binary" * decode)

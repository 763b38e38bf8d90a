"""Product quantization of vectors: codebooks by Lloyd's rounds over cover trees, and the codes of all vectors.

A vector's components become integers, and the vector is cut into equal parts, each with a codebook of its own. A round of
Lloyd assigns every part to the nearest entry and moves the entries to the mean of their parts.

Vectors lie in blocks, and each block has a cover tree for each part, built once and written: a node covers all its
points within a radius, and the nodes below it cover theirs within half of that, their centres being further apart. Points are
kept in the order of the tree, with cumulative sums, so a node's number of points and their sum are one subtraction. To
assign a block, nodes are met level by level with the entries that may be nearest to some point of theirs: by the triangle
inequality an entry is out if it is further from the centre than another one by more than twice the radius. A node with
one entry left is assigned as a whole; others hand their entries down, and at the leaves points are compared exactly,
in integers. Only the sums for each entry leave a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BLOCK_ROWS = 4096
# nodes of so few points are not divided
LEAF_POINTS = 24
# of the scaled components; sums of 2^39 of them fit 64-bit integers
MOST = 1 << 24


def usable(vector: Column) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def scaled(vectors: pa.Array, parts: int) -> np.ndarray:
    """floor(SCALE * x) as int64 (parts x rows x components of a part). All vectors must have the same number of components,
    which `parts` divides, and no scaled component may reach MOST: both are errors."""
    rows = len(vectors)
    sizes = np.asarray(vectors.value_lengths())
    if rows and (sizes.min() != sizes.max() or sizes[0] % parts):
        raise ValueError(f"vectors must have one number of components, a multiple of {parts}")
    flat = np.floor(np.asarray(vectors.flatten(), "float64") * SCALE)
    if len(flat) and np.abs(flat).max() >= MOST:
        raise ValueError(f"a component times {SCALE} reaches {MOST}")
    return flat.astype(np.int64).reshape(rows, parts, int(sizes[0]) // parts if rows else 0).transpose(1, 0, 2)


class _Squares:
    """Exact squared distances of places to all entries of their part, by one product for each part. All numbers on the way
    are whole and below 2^53, so floats hold them exactly; larger ones are refused."""

    def __init__(self, points: np.ndarray, books: np.ndarray):
        largest = max(int(np.abs(points).max(initial=0)), int(np.abs(books).max(initial=0)))
        if 4 * books.shape[2] * largest ** 2 >= 1 << 53:
            raise ValueError("components are too large for exact distances")
        self.points, self.books = points.astype(float), books.astype(float)
        self.lengths, self.book_lengths = (self.points ** 2).sum(axis=1), (self.books ** 2).sum(axis=2)

    def __call__(self, places: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """places x entries; `parts` are in order."""
        out = np.empty((len(places), self.books.shape[1]))
        edges = np.searchsorted(parts, np.arange(len(self.books) + 1))
        for part, (low, high) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if high > low:
                at = places[low:high]
                np.matmul(self.points[at], self.books[part].T * -2, out=out[low:high])
                out[low:high] += self.lengths[at][:, None]
                out[low:high] += self.book_lengths[part]
        return out


class Forest:
    """Cover trees over the parts of one block, level by level.

    `points` are those of part 0 in the order of its tree, then those of part 1 and so on; `rows` has the row of each.
    A node has a centre (a place in `points`), a radius, the range of places that it covers and that of its children among the
    nodes; leaves have none. The first nodes are the roots, one for each part.
    """

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray,
                 first: np.ndarray, last: np.ndarray, parts: int):
        self.points, self.rows, self.centre, self.radius, self.low, self.high, self.first, self.last = points, rows, centre, radius, low, high, first, last
        self.parts = parts

    @classmethod
    def grown(cls, cut: np.ndarray) -> Forest:
        """From the parts x rows x components of a block."""
        parts, n, _ = cut.shape
        points = cut.reshape(parts * n, -1)
        order = np.arange(parts * n)  # places by tree, to be permuted node by node
        low, high = np.arange(parts) * n, np.arange(1, parts + 1) * n
        centre = low.copy()  # as indices of `points` until the end
        distance = np.sqrt(((points - np.repeat(points[centre], n, axis=0)) ** 2).sum(axis=1).astype(float))
        radius = np.maximum.reduceat(distance, low)
        done: list[list[np.ndarray]] = []
        made = 0
        while len(low):
            made += len(low)
            split = np.flatnonzero((high - low > LEAF_POINTS) & (radius > 0))
            first, last = np.full(len(low), made), np.full(len(low), made)
            sizes = (high - low)[split]
            place = np.repeat(low[split] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            own, node = order[place], np.repeat(np.arange(len(split)), sizes)
            reach = radius[split] / 2
            child_of, child_distance = np.full(len(own), -1), np.zeros(len(own))
            open_, n_children = np.arange(len(own)), np.zeros(len(split), np.int64)
            first_own = np.cumsum(sizes) - sizes
            centres: list[np.ndarray] = []
            while len(open_):
                # each node's next centre: its own, then its first point that is not covered yet
                nodes, at = np.unique(node[open_], return_index=True)
                chosen = np.full(len(split), -1)
                chosen[nodes] = own[open_[at]] if centres else centre[split[nodes]]
                d = np.sqrt(((points[own[open_]] - points[chosen[node[open_]]]) ** 2).sum(axis=1).astype(float))
                inside = d <= reach[node[open_]]
                child_of[open_[inside]] = n_children[node[open_[inside]]]
                child_distance[open_[inside]] = d[inside]
                n_children[nodes] += 1
                centres.append(chosen)
                open_ = open_[~inside]
            # points of a child together, children in the order of their making
            by_child = np.lexsort((child_of, node))
            order[place] = own[by_child]
            offsets = np.cumsum(n_children) - n_children
            child = (offsets[node] + child_of)[by_child]
            begins = np.searchsorted(child, np.arange(n_children.sum()))
            first[split] += offsets
            last[split] += offsets + n_children
            done.append([centre, radius, low, high, first, last])
            which = np.repeat(np.arange(len(split)), n_children)
            turn = np.arange(n_children.sum()) - offsets[which]
            low = low[split][which] + begins - first_own[which]
            high = low + np.diff(np.append(begins, len(own)))
            centre = np.array([], np.int64) if not len(centres) else np.stack(centres)[turn, which]
            radius = np.maximum.reduceat(child_distance[by_child], begins) if len(begins) else np.zeros(0)
        centre, radius, low, high, first, last = (np.concatenate(c) for c in zip(*done))
        placed = np.empty(len(order), np.int64)
        placed[order] = np.arange(len(order))
        return cls(points[order], order % max(n, 1), placed[centre], radius, low, high, first, last, parts)

    def packed(self) -> bytes:
        kind = np.int16 if not self.points.size or np.abs(self.points).max() < 1 << 15 else np.int32
        numbers = [self.points.astype(kind), self.rows.astype(np.uint16), self.centre.astype(np.uint32), self.radius, self.low.astype(np.uint32),
                   self.high.astype(np.uint32), self.first.astype(np.uint32), self.last.astype(np.uint32)]
        head = np.array([self.parts, len(self.points), self.points.shape[1], len(self.centre), np.dtype(kind).itemsize], np.int64)
        return head.tobytes() + b"".join(a.tobytes() for a in numbers)

    @classmethod
    def unpacked(cls, data: bytes) -> Forest:
        parts, n, width, nodes, size = np.frombuffer(data, np.int64, 5).tolist()
        at, out = 40, []
        for kind, count in ((f"<i{size}", n * width), ("<u2", n), ("<u4", nodes), ("<f8", nodes), *[("<u4", nodes)] * 4):
            out.append(np.frombuffer(data, kind, count, at))
            at += out[-1].nbytes
        points, rows, centre, radius, *ranges = out
        return cls(points.astype(np.int64).reshape(n, width), rows, centre.astype(np.int64), radius, *[r.astype(np.int64) for r in ranges], parts)

    def assigned(self, books: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What the entries of `books` (parts x entries x components) get: ranges of places (low, high, entry), each place in one."""
        n_entries, out, squares = books.shape[1], [], _Squares(self.points, books)
        each = len(self.points) // self.parts if self.parts else 0
        nodes = np.arange(self.parts if len(self.points) else 0)
        may = np.ones((len(nodes), n_entries), bool)
        while len(nodes):
            # nodes of a level are in the order of their places, part by part
            away = np.sqrt(squares(self.centre[nodes], self.low[nodes] // each))
            away[~may] = np.inf
            # a little more than the triangle inequality asks, for rounding
            may &= away <= ((away.min(axis=1) + 2 * self.radius[nodes]) * (1 + 1e-9))[:, None]
            sure = may.sum(axis=1) == 1
            whole = nodes[sure]
            out.append((self.low[whole], self.high[whole], may[sure].argmax(axis=1)))
            nodes, may = nodes[~sure], may[~sure]
            leaf = self.first[nodes] == self.last[nodes]
            # the points of ambiguous leaves against the entries that are left, exactly; of equals the first entry
            sizes = np.where(leaf, (self.high - self.low)[nodes], 0)
            place = np.repeat(self.low[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            d = squares(place, place // max(each, 1)).astype(float)
            d[~np.repeat(may, sizes, axis=0)] = np.inf
            out.append((place, place + 1, d.argmin(axis=1)))
            sizes = (self.last - self.first)[nodes]
            nodes = np.repeat(self.first[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            may = np.repeat(may, sizes, axis=0)
        return out

    def sums(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of points (parts x entries) and their sums (parts x entries x components), by differences of cumulative sums."""
        parts, entries, width = books.shape
        total = np.zeros((len(self.points) + 1, width), np.int64)
        np.cumsum(self.points, axis=0, out=total[1:])
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        each = len(self.points) // parts if parts else 0
        for low, high, entry in self.assigned(books):
            at = low // max(each, 1) * entries + entry
            np.add.at(counts, at, high - low)
            np.add.at(sums, at, total[high] - total[low])
        return counts.reshape(parts, entries), sums.reshape(parts, entries, width)

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's entries (rows x parts) and its summed squared distance to them."""
        each = len(self.points) // self.parts if self.parts else 0
        codes, errors = np.zeros((each, self.parts), np.uint8), np.zeros(each, np.int64)
        for low, high, entry in self.assigned(books):
            sizes = high - low
            place = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            entry, part = np.repeat(entry, sizes), place // max(each, 1)
            codes[self.rows[place], part] = entry
            np.add.at(errors, self.rows[place], ((self.points[place] - books[part, entry]) ** 2).sum(axis=1))
        return codes, errors


def _forests(vectors: DataFrame, parts: int) -> DataFrame:
    """(ids, labels, forest): a row for each block of the rows (id, label, vector)."""
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in ("id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def made(table: pa.Table) -> pa.RecordBatch:
            ids, labels, own = (table[c].combine_chunks() for c in ("id", "label", "vector"))
            ends = pa.array([0, len(table)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, labels),
                                               pa.array([Forest.grown(scaled(own, parts)).packed()], pa.binary())], ["ids", "labels", "forest"])

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= BLOCK_ROWS:
                table = pa.Table.from_batches(waiting)
                whole = len(table) // BLOCK_ROWS * BLOCK_ROWS
                for low in range(0, whole, BLOCK_ROWS):
                    yield made(table.slice(low, BLOCK_ROWS))
                waiting = table.slice(whole).to_batches()
        if waiting and sum(b.num_rows for b in waiting):
            yield made(pa.Table.from_batches(waiting))

    return vectors.mapInArrow(run, f"ids array<{id_type}>, labels array<{label_type}>, forest binary")


def first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors of the `entries` smallest ids, parts x entries x components. Rows of one id give one entry, that of
    the smallest vector; rows without an id give none."""
    ids = [r[0] for r in vectors.where(F.col("id").isNotNull()).select("id").distinct().orderBy("id").limit(entries).collect()]
    rows = vectors.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").toArrow()  # `entries` rows at most
    return scaled(rows["vector"].combine_chunks(), parts).copy()


def moved(books: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The entries at the mean of their points, rounded down; those without points stay."""
    means = np.floor_divide(sums, np.maximum(counts, 1)[..., None])
    return np.where((counts > 0)[..., None], means, books)


def fitted(forests: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after some rounds of Lloyd over all blocks. Each round brings one row for each entry to the driver."""
    parts, entries, width = books.shape
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
            for batch in batches:
                for data in batch.column(0):
                    some, of_some = Forest.unpacked(data.as_py()).sums(books)
                    counts, sums = counts + some, sums + of_some
            at = np.flatnonzero(counts.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts.ravel()[at], pa.int64()),
                                              pa.array(list(sums.reshape(-1, width)[at]), pa.list_(pa.int64()))], ["at", "n", "total"])

        found = forests.select("forest").mapInArrow(run, "at int, n bigint, total array<bigint>")
        every = found.groupBy("at").agg(F.sum("n"), *[F.sum(F.get("total", F.lit(k))) for k in range(width)]).collect()
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for at, n, *total in every:
            counts[at], sums[at] = n, total
        books = moved(books, counts.reshape(parts, entries), sums.reshape(parts, entries, width))
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(forests: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of every row: its entries as two hex digits each, and its squared distance to them."""
    id_type, label_type = (forests.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(batch.column(2)):
                codes, errors = Forest.unpacked(data.as_py()).codes(books)
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([one.column(0).flatten(), one.column(1).flatten(),
                                                  pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors)], ["id", "label", "code", "error"])

    return forests.select("ids", "labels", "forest").mapInArrow(run, f"id {id_type}, label {label_type}, code string, error bigint")


def encode_vectors(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every row whose vector is not null and has finite components only.

    Codebooks start from the vectors of the smallest ids (see `first_books`); `label_error` is the error summed over the rows
    of the same label, those without one together. Rows that repeat an id or a vector are coded each. Where no row is left
    there are no rows; where none of the rows has an id there is nothing to start from, which is an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    kept = docs.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    forests = stage(_forests(kept, parts), "vector-forests")
    books = first_books(kept, parts, entries)
    if not books.shape[1] and not forests.isEmpty():
        raise ValueError("no vector has an id to start from")
    books = fitted(forests, books, rounds) if books.size else books
    rows = stage(coded(forests, books), "vector-codes")
    errors = rows.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return rows.join(errors, rows["label"].eqNullSafe(errors["__label"])).select(
        "id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))

"""Log-probabilities of texts under an n-gram model of the corpus, by a weighted backoff automaton.

Tokens are words in lower case (A-Z only) and one end for each text. The model counts all n-grams of up to `order` tokens
in the texts that it learns from and smooths them towards shorter ones (a Dirichlet prior of weight `prior`):

    p(w)     = (c(w) + 1) / (N + V + 1)                    one share is for all unknown words together
    p(w | h) = (c(h w) + prior * p(w | h')) / (c(h) + prior)   h' is h without its first token

As an automaton: a state for each n-gram below `order` tokens that was seen, an arc for each n-gram seen, and a failure
arc of weight prior / (c(h) + prior) from h to h' for all other tokens. A text is scored in one walk from left to right.

The counts are never in one place. Texts are cut into blocks of bounded size, and each block sends its distinct n-grams
(hashed, words to 64 bits) with its own counts to buckets by hash, as sorted arrays. A bucket adds up what all blocks have and
answers each of them, but only with n-grams whose total is not the block's own count, so what occurs in one block only is
never sent back. With these answers a block has all that its automaton needs. Both exchanges grow with the input; a frequent
n-gram is one entry in each block, and a long text is cut into several blocks, each led by the tokens before it.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import let_go, stage

ORDER = 2
PRIOR = 20.0
HELD_OUT_OF, HELD_OUT = 7, 2
# tokens of a block, distinct n-grams of a bucket, and bytes of a text that are cut into words at a time
BLOCK_TOKENS = 1 << 19
BUCKET_GRAMS = 1 << 22
CUT_AT_ONCE = 1 << 22
END = b"\n"  # no word holds a line break
_BLANK = b" \t\n\x0b\x0c\r"


def is_held_out(doc_id) -> bool:
    """By the id written as text; a null id is an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT_OF == HELD_OUT


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words in lower case, a bounded piece of the text at a time. A null text has none."""
    data, at = (text or "").encode("utf-8", "surrogatepass"), 0
    while at < len(data):
        end = at + CUT_AT_ONCE
        while end < len(data) and data[end] not in _BLANK:
            end += 1
        yield data[at:end].lower().split()
        at = end


def mixed(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The 64-bit hash of an n-gram from those of all but its last token and of that token."""
    x = prefix * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


class Grams:
    """All distinct n-grams of a block, level by level: level 0 has the words, level k the n-grams of k + 1 words.

    `ids[k]` has for each token the n-gram of level k that ends there, -1 where its text (or what leads it) is too
    short. For each n-gram: its prefix of one token less, its last word, its suffix of one token less, its hash, and
    how often it ends at a token that is counted.
    """

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, counted: np.ndarray, hashes: np.ndarray, order: int):
        n, words = len(tokens), len(hashes)
        begins = np.zeros(n, np.int64)
        begins[starts] = starts
        depth = np.arange(n) - np.maximum.accumulate(begins)  # tokens of the same text before this one
        self.ids, self.prefix, self.word, self.suffix = [tokens.astype(np.int64)], [None], [np.arange(words)], [None]
        self.keys, self.local = [hashes], [np.bincount(tokens[counted], minlength=words)]
        for k in range(1, order):
            at = np.flatnonzero(depth >= k)
            pair = self.ids[k - 1][at - 1] * words + tokens[at]
            distinct, first, which = np.unique(pair, return_index=True, return_inverse=True)
            ids = np.full(n, -1, np.int64)
            ids[at] = which
            self.ids.append(ids)
            self.prefix.append(distinct // words)
            self.word.append(distinct % words)
            self.suffix.append(self.ids[k - 1][at][first])
            self.keys.append(mixed(self.keys[k - 1][self.prefix[k]], hashes[self.word[k]] + np.uint64(k)))
            self.local.append(np.bincount(which[counted[at]], minlength=len(distinct)))

    def sorted_keys(self, kind: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of `width` bytes, local counts and places of the words (kind 0) or of all longer n-grams (kind 1), by key."""
        levels = slice(0, 1) if kind == 0 else slice(1, None)
        keys = np.concatenate([np.zeros(0, np.uint64), *self.keys[levels]]) >> np.uint64(64 - 8 * width)
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([np.zeros(0, np.int64), *self.local[levels]])[order], order


class Automaton:
    """States, weighted arcs and failure arcs from the counts of one block's n-grams in the whole corpus."""

    def __init__(self, grams: Grams, totals: list[np.ndarray], n_tokens: int, n_words: int, prior: float):
        order, self.words = len(totals), len(totals[0])
        offsets = np.cumsum([1, *map(len, totals)])  # state 0 has no history
        self.base = np.log10((totals[0] + 1) / (n_tokens + n_words + 1))
        self.known = totals[0] > 0
        p = (totals[0] + 1) / (n_tokens + n_words + 1)
        seen = np.arange(self.words) if order == 1 else np.where(self.known, offsets[0] + np.arange(self.words), 0)
        keys, weights, targets = [np.arange(self.words)], [np.log10(p)], [np.zeros(self.words, np.int64) if order == 1 else seen]
        fail, fail_weight = [np.zeros(1, np.int64)], [np.zeros(1)]
        for k in range(1, order):
            history = totals[k - 1][grams.prefix[k]]
            p = (totals[k] + prior * p[grams.suffix[k]]) / (history + prior)
            arcs = np.flatnonzero(totals[k] > 0)
            keys.append((offsets[k - 1] + grams.prefix[k][arcs]) * self.words + grams.word[k][arcs])
            weights.append(np.log10(p[arcs]))
            longest = k == order - 1
            targets.append((offsets[k - 1] + grams.suffix[k] if longest else offsets[k] + np.arange(len(p)))[arcs])
            # the states of level k - 1, whose histories have k tokens
            fail.append(np.zeros(self.words, np.int64) if k == 1 else offsets[k - 2] + grams.suffix[k - 1])
            fail_weight.append(np.log10(prior / (totals[k - 1] + prior)))
        self.arcs = dict(zip(np.concatenate(keys).tolist(), zip(np.concatenate(weights).tolist(), np.concatenate(targets).tolist())))
        self.fail = list(zip(np.concatenate(fail_weight).tolist(), np.concatenate(fail).tolist()))

    def walk(self, tokens: list[int], lead: int) -> float:
        """log10 of the probability of the tokens after the first `lead`, which only set the state."""
        arcs, fail, words, state, total = self.arcs, self.fail, self.words, 0, 0.0
        for i, w in enumerate(tokens):
            if i == lead:
                total = 0.0
            found = arcs.get(state * words + w)
            while found is None:
                weight, state = fail[state]
                total += weight
                found = arcs.get(state * words + w)
            total += found[0]
            state = found[1]
        return total


def _blocks(docs: DataFrame, id_col: str, text_col: str, order: int) -> DataFrame:
    """(block, rows, ids, held, leads, sizes, tokens, words, n_words, n_tokens, n_train): one row for each block. A block holds
    pieces of texts, each with its row's number, the row's id, whether that is held out, the number of tokens that only
    lead it and of those that are its own. Tokens are places in the block's own list of word hashes, most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        part, block, row = TaskContext.get().partitionId() << 33, 0, 0
        index: defaultdict = defaultdict(count().__next__)
        pieces: list = []
        tokens: list[int] = []

        def flushed():
            nonlocal index, pieces, tokens, block
            taken, hashes = np.array(tokens, np.int64), np.array([xxhash.xxh64_intdigest(w) for w in index], np.uint64)
            frequent = np.argsort(-np.bincount(taken, minlength=len(hashes)), kind="stable")
            place = np.empty(len(hashes), np.int64)
            place[frequent] = np.arange(len(hashes))
            taken, hashes = place[taken].astype("<u4"), hashes[frequent]
            planes = taken.view(np.uint8).reshape(-1, 4).T.copy()  # frequent words have zeros in the high bytes
            leads, sizes, held = (np.array([p[k] for p in pieces], np.int64) for k in (3, 4, 2))
            out = pa.RecordBatch.from_arrays([
                pa.array([part | block], pa.int64()), pa.array([[p[0] for p in pieces]], pa.list_(pa.int64())),
                pa.array([[p[1] for p in pieces]], pa.list_(id_arrow)), pa.array([held.astype(bool).tolist()], pa.list_(pa.bool_())),
                pa.array([leads.tolist()], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int64())),
                pa.array([zlib.compress(planes.tobytes(), 1)], pa.binary()), pa.array([hashes.tobytes()], pa.binary()),
                pa.array([len(hashes)], pa.int64()), pa.array([len(taken)], pa.int64()), pa.array([int(sizes[held == 0].sum())], pa.int64())], names)
            index, pieces, tokens, block = defaultdict(count().__next__), [], [], block + 1
            return out

        for batch in batches:
            id_arrow = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, last = is_held_out(doc_id), []
                for some in _with_end(words_of(text)):
                    for low in range(0, len(some), BLOCK_TOKENS):
                        if tokens and len(tokens) + min(BLOCK_TOKENS, len(some) - low) > BLOCK_TOKENS:
                            yield flushed()
                        own = some[low: low + BLOCK_TOKENS]
                        pieces.append((part | row, doc_id, held, len(last), len(own)))
                        tokens.extend(map(index.__getitem__, last + own))
                        last = (last + own)[max(0, len(last) + len(own) - order + 1):] if order > 1 else []
                row += 1
        if tokens:
            yield flushed()

    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    names = ["block", "rows", "ids", "held", "leads", "sizes", "tokens", "words", "n_words", "n_tokens", "n_train"]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"block bigint, rows array<bigint>, ids array<{id_type}>, held array<boolean>, leads array<bigint>, sizes array<bigint>, "
             "tokens binary, words binary, n_words bigint, n_tokens bigint, n_train bigint")


def _with_end(pieces: Iterator[list[bytes]]) -> Iterator[list[bytes]]:
    """The pieces, with the end in the last one."""
    last: list[bytes] = []
    for some in pieces:
        if last:
            yield last
        last = some
    yield [*last, END]


def _grams(tokens: np.ndarray, leads: np.ndarray, sizes: np.ndarray, held: np.ndarray, hashes: np.ndarray, order: int) -> Grams:
    whole = leads + sizes
    starts = np.cumsum(whole) - whole
    place = np.arange(len(tokens)) - np.repeat(starts, whole)
    counted = (place >= np.repeat(leads, whole)) & ~np.repeat(held.astype(bool), whole)
    return Grams(tokens.astype(np.int64), starts, counted, hashes, order)


def _unpacked(tokens: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(tokens), np.uint8).reshape(4, -1)
    return planes.T.copy().view("<u4")[:, 0]


def _block_of(row: dict, order: int) -> tuple[np.ndarray, Grams]:
    tokens = _unpacked(row["tokens"])
    leads, sizes, held = (np.array(row[k], np.int64) for k in ("leads", "sizes", "held"))
    return tokens, _grams(tokens, leads, sizes, held, np.frombuffer(row["words"], "<u8"), order)


def key_width(n: int) -> int:
    """Bytes of a hash with which about one of `n` keys in four million has another's."""
    return min(8, -(-(n.bit_length() + 22) // 8))


def _steps_packed(numbers: np.ndarray, width: int) -> bytes:
    """Ascending numbers of `width` bytes as the steps between them, all lowest bytes first: the high bytes of the steps are
    zeros, which the compression of shuffles and tables takes away."""
    steps = np.diff(numbers.astype("<u8"), prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _steps_unpacked(data: bytes, width: int) -> np.ndarray:
    steps = np.zeros((len(data) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return np.cumsum(steps.view("<u8")[:, 0], dtype=np.uint64)


def _counts_packed(counts: np.ndarray) -> bytes:
    """One byte each, and the larger ones behind."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[small == 255].astype("<u8").tobytes()


def _counts_unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n).astype(np.int64)
    return out


def _edges(keys: np.ndarray, width: int, buckets: int) -> np.ndarray:
    """Where each bucket, an equal range of keys, begins among sorted keys, and where the last one ends."""
    bounds = [((b << 8 * width) + buckets - 1) // buckets for b in range(1, buckets)]
    return np.array([0, *np.searchsorted(keys, np.array(bounds, np.uint64)).tolist(), len(keys)])


def _requests(blocks: DataFrame, order: int, buckets: list[int], widths: list[int]) -> DataFrame:
    """(kind, bucket, block, keys, counts) for each block and bucket of words (kind 0) or longer n-grams (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = _block_of(row, order)[1]
                for kind, (n, width) in enumerate(zip(buckets, widths)):
                    keys, local, _ = grams.sorted_keys(kind, width)
                    edges = _edges(keys, width, n)
                    some = np.flatnonzero(edges[1:] > edges[:-1])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([kind] * len(some), pa.int32()), pa.array(some, pa.int64()), pa.array([row["block"]] * len(some), pa.int64()),
                        pa.array([_steps_packed(keys[edges[b]: edges[b + 1]], width) for b in some], pa.binary()),
                        pa.array([_counts_packed(local[edges[b]: edges[b + 1]]) for b in some], pa.binary())], ["kind", "bucket", "block", "keys", "counts"])

    return blocks.select("block", "held", "leads", "sizes", "tokens", "words").mapInArrow(
        run, "kind int, bucket bigint, block bigint, keys binary, counts binary")


def _answered(table: pa.Table, widths: list[int]) -> pa.Table:
    """What one bucket answers its blocks: (kind, bucket, block, places, totals, n_seen). `places` are those of the block's own
    n-grams in this bucket whose total is another than its own count. `n_seen`, on one row, is the number of n-grams seen."""
    width = widths[table["kind"][0].as_py()]
    keys = [_steps_unpacked(k.as_py(), width) for k in table["keys"]]
    sizes = np.array([len(k) for k in keys])
    local = np.concatenate([_counts_unpacked(c.as_py(), n) for c, n in zip(table["counts"], sizes.tolist())])
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, which, local)
    mine = totals[which]
    ends = np.cumsum(sizes)
    places, answers = [], []
    for low, high in zip((ends - sizes).tolist(), ends.tolist()):
        at = np.flatnonzero(mine[low:high] != local[low:high])
        places.append(_steps_packed(at, 4))
        answers.append(_counts_packed(mine[low:high][at]))
    n_seen = np.zeros(len(sizes), np.int64)
    n_seen[0] = int((totals > 0).sum())
    return pa.table({"kind": table["kind"], "bucket": table["bucket"], "block": table["block"], "places": pa.array(places, pa.binary()),
                     "totals": pa.array(answers, pa.binary()), "n_seen": pa.array(n_seen)})


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row's whole text.

    The model learns from the rows that are not held out. A null or empty text has the end as its only token; a null id
    counts as an empty one and is learned from; rows that repeat an id or a text are scored (and learned from) each. Where
    nothing is learned from, all tokens share one probability of 1. An empty table gives no rows.
    """
    if order < 1 or prior <= 0:
        raise ValueError("order must be 1 or more and prior above 0")
    blocks = stage(_blocks(docs, id_col, text_col, order), "lm-blocks")
    sums = blocks.agg(*[F.sum(c).alias(c) for c in ("n_words", "n_tokens", "n_train")]).first()
    train_tokens, sizes = int(sums["n_train"] or 0), [int(sums["n_words"] or 0), (order - 1) * int(sums["n_tokens"] or 0)]
    buckets, widths = [max(1, -(-n // BUCKET_GRAMS)) for n in sizes], [8, key_width(sizes[1])]
    answers = stage(_requests(blocks, order, buckets, widths).groupBy("kind", "bucket").applyInArrow(
        lambda table: _answered(table, widths), "kind int, bucket bigint, block bigint, places binary, totals binary, n_seen bigint"), "lm-answers")
    train_words = int(answers.where("kind = 0").agg(F.sum("n_seen")).first()[0] or 0)
    let_go(docs.sparkSession)  # the requests' shuffle files; Spark has heard by now that their query has ended
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def scored(own: pa.Table, answered: pa.Table) -> pa.Table:
        row = own.slice(0, 1).to_pylist()[0]
        tokens, grams = _block_of(row, order)
        by_kind = []
        for kind in (0, 1):
            keys, totals, places = grams.sorted_keys(kind, widths[kind])
            edges = _edges(keys, widths[kind], buckets[kind])
            for k, b, at, new in zip(*(answered[c].to_pylist() for c in ("kind", "bucket", "places", "totals"))):
                if k == kind:
                    at = edges[b] + _steps_unpacked(at, 4).astype(np.int64)
                    totals[at] = _counts_unpacked(new, len(at))
            whole = np.empty_like(totals)
            whole[places] = totals
            by_kind.append(whole)
        by_level = [by_kind[0], *np.split(by_kind[1], np.cumsum([len(k) for k in grams.keys[1:]])[:-1])][:order]
        automaton = Automaton(grams, by_level, train_tokens, train_words, prior)
        known, base, score, start = [], [], [], 0
        for lead, size in zip(row["leads"], row["sizes"]):
            part = tokens[start: start + lead + size]
            known.append(int(automaton.known[part[lead:]].sum()))
            base.append(float(automaton.base[part[lead:]].sum()))
            score.append(automaton.walk(part.tolist(), lead))
            start += lead + size
        return pa.table({"row": own["rows"].combine_chunks().flatten(), "id": own["ids"].combine_chunks().flatten(), "held_out": pa.array(row["held"], pa.bool_()),
                         "n_tokens": pa.array(row["sizes"], pa.int64()), "n_known": pa.array(known, pa.int64()),
                         "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})

    own = blocks.select("block", "rows", "ids", "held", "leads", "sizes", "tokens", "words")
    pieces = own.groupBy("block").cogroup(answers.select("block", "kind", "bucket", "places", "totals").groupBy("block")).applyInArrow(
        scored, f"row bigint, id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return pieces.groupBy("row").agg(F.first("id").alias("id"), F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
                                     F.sum("n_known").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
                                     F.sum("base_score").alias("base_score"), F.sum("score").alias("score")).drop("row")

"""Token counts under a unigram model, scored over a trie of distinct pre-tokens.

The unigram segmentation of a pre-token maximises the summed log probabilities of its pieces. The best score up to a
position depends only on the characters before it, so pre-tokens with a common prefix share these scores. Distinct
pre-tokens are put in order, which visits the trie depth first; going from one word to the next keeps the scores of
the common prefix and computes the rest. A word's terminal node gives its number of tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .worker import worker_local

SPACE = "▁"  # stands before a pre-token, as in the vocabulary
# distinct pre-tokens whose counts a worker keeps at once; beyond that it starts anew, with the same results
MOST_KEPT = 1 << 19


class UnigramModel:
    """Pieces with log probabilities, and one for a byte of a character that no piece holds."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte_score = scores, byte_score
        self.longest = max(map(len, scores), default=0)

    @classmethod
    def from_sentencepiece(cls, path: str) -> UnigramModel:
        """The vocabulary of a sentencepiece model. Its pieces are in order of frequency but carry no probabilities;
        by Zipf's law the piece of rank r gets a probability in proportion to 1 / r. Bytes get that of the last rank."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
                  if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        total = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
        return cls({p: -math.log(r) - total for r, p in enumerate(pieces, 1)}, -math.log(len(pieces) + 1) - total)

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of each distinct word; of equally good segmentations the one with the fewest tokens."""
        scores, longest, byte_score = self.scores, self.longest, self.byte_score
        found, before = {}, ""
        best: list[tuple[float, int]] = [(0.0, 0)]  # per prefix: score, and minus the number of tokens
        for word in sorted(set(words)):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:]
            for j in range(shared + 1, len(word) + 1):
                width = len(word[j - 1].encode("utf-8", "surrogatepass"))
                score, count = best[j - 1]
                top = (score + width * byte_score, count - width)
                for i in range(max(0, j - longest), j):
                    piece = scores.get(word[i:j])
                    if piece is not None:
                        score, count = best[i]
                        if (score + piece, count - 1) > top:
                            top = (score + piece, count - 1)
                best.append(top)
            found[word] = -best[len(word)][1]
            before = word
        return found


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pretokens, n_tokens) of every row's whole text. Pre-tokens are the stretches between ASCII white space,
    each with the space mark before it. A null or empty text has 0 of both. The model file must be on every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_local(("unigram", model_path), lambda: UnigramModel.from_sentencepiece(model_path))
        memo: dict[bytes, int] = worker_local(("unigram-counts", model_path), dict)
        for batch in batches:
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column(1).to_pylist()]
            new = set().union(*words)
            new.difference_update(memo)
            if len(memo) + len(new) > MOST_KEPT:
                memo.clear()
                new = set().union(*words)
            marked = {SPACE + w.decode("utf-8", "surrogatepass"): w for w in new}
            memo.update((marked[m], n) for m, n in model.counts(marked).items())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, words), pa.int64()), pa.array(
                (sum(map(memo.__getitem__, w)) for w in words), pa.int64())], ["id", "n_pretokens", "n_tokens"])

    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, n_pretokens bigint, n_tokens bigint")

"""Token ids of whole texts with the `tokenizers` library, each distinct stretch encoded once.

A byte-level or word-level pre-tokenizer never joins characters across certain places, so a text can be cut there,
each distinct stretch encoded once and the ids put together: the ids are those of the whole text. New stretches are
joined by a mark that such a place surrounds, many to a text, and their ids are cut at the mark's id again.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .worker import worker_local

# White space as Unicode has it; Python's \s also holds U+001C to U+001F.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STRETCH = re.compile(rf" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]")
# distinct stretches whose ids a worker keeps at once; beyond that it starts anew, with the same results
MOST_KEPT = 1 << 20
# new stretches that go to the tokenizer as one text: each call for a text costs more than a stretch does
JOINED = 64


def _singly_spaced(text: str) -> bool:
    """Whether all white space stands alone, between other characters, and is a space or a line break."""
    flat = text.replace("\n", " ")
    if flat.isprintable():  # no white space but spaces, and no \0
        return "  " not in flat and flat[0] != " " and flat[-1] != " "
    words = text.split()
    gaps = text.count(" ") + text.count("\n")
    return len(words) == gaps + 1 and len(text) == gaps + sum(map(len, words)) and "\0" not in text


def led_by_space(text: str) -> list[str]:
    """Cut before each space that another character follows, and around line breaks; white space in a row is cut as
    byte-level patterns cut it, all but its last character together."""
    if not text:
        return []
    if not _singly_spaced(text):
        return STRETCH.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def distinct_led_by_space(texts: list[str | None]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct stretches of some texts, cut as `led_by_space` does, and for each text the places of its own among them."""
    plain = [bool(t) and _singly_spaced(t) for t in texts]
    marked = pa.array([t for t, p in zip(texts, plain) if p], pa.large_string())
    cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(marked, " ", "\0 "), "\n", "\0\n\0"), "\0")
    others = [STRETCH.findall(t or "") for t, p in zip(texts, plain) if not p]
    coded = pa.concat_arrays([cut.flatten(), pa.array(chain.from_iterable(others), pa.large_string())]).dictionary_encode()
    places, order = coded.indices.to_numpy(), np.argsort(~np.array(plain, bool), kind="stable")
    sizes = np.concatenate([pc.list_value_length(cut).to_numpy(), np.array(list(map(len, others)), np.int64)])
    own: list = [None] * len(texts)
    for k, part in zip(order.tolist(), np.split(places, np.cumsum(sizes)[:-1])):
        own[k] = part
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), own


def between_spaces(text: str) -> list[str]:
    """Cut at spaces and line breaks, which are dropped."""
    return [w for w in text.replace("\n", " ").split(" ") if w]


def known_stretches(memo: dict[str, bytes], parts: list[list[str]]) -> tuple[list[list[bytes | None]], list[list[int]], set[str]]:
    """For each text what the memo has of its stretches and the places that it lacks; the distinct stretches that it lacks."""
    get, found, gaps, new = memo.get, [], [], set()
    for part in parts:
        ids, at, k = list(map(get, part)), [], -1
        lacking = ids.count(None)
        if lacking * 4 > len(ids):
            at = [k for k, value in enumerate(ids) if value is None]
        else:
            for _ in range(lacking):
                k = ids.index(None, k + 1)
                at.append(k)
        new.update([part[k] for k in at])
        found.append(ids)
        gaps.append(at)
    return found, gaps, new


class TextEncoder:
    """Encodes texts to little-endian ids of `width` bytes, without special tokens; their strings are ordinary text."""

    def __init__(self, path: str, width: int = 4):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width, self.memo = width, {}
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        steps = stated.get("pre_tokenizer") or {}
        kinds = [(s["type"], s.get("behavior"), s.get("use_regex"), s.get("add_prefix_space")) for s in steps.get("pretokenizers", [steps]) if s]
        if stated.get("normalizer") is None and kinds == [("ByteLevel", None, True, False)]:
            self.cut, between = led_by_space, "\n"
        elif kinds[:1] == [("Split", "Removed", None, None)] and "\\s" in str(steps["pretokenizers"][0]["pattern"]):
            self.cut, between = between_spaces, " \1 "
        else:  # an unknown pre-tokenizer: whole texts
            self.cut, between = (lambda text: [text]), ""
        # what stands between joined stretches must be one id, which no stretch without its mark can have
        marks = self.tokenizer.encode(f"a{between}a", add_special_tokens=False).ids[1:-1] if between else []
        self.between, self.mark = (between, marks[0]) if len(marks) == 1 else ("", -1)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, "<u8") for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _packed(self, ids: np.ndarray) -> bytes:
        return ids.view(np.uint8).reshape(-1, 8)[:, : self.width].tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        parts = [self.cut(t or "") for t in texts]
        found, gaps, new = known_stretches(self.memo, parts)
        if len(self.memo) + len(new) > MOST_KEPT:
            self.memo.clear()
            found, gaps, new = known_stretches(self.memo, parts)
        self._learn(new)
        for ids, part, at in zip(found, parts, gaps):
            for k in at:
                ids[k] = self.memo[part[k]]
        return [b"".join(ids) for ids in found]

    def _learn(self, new: set[str]) -> None:
        """Encode stretches and keep their ids."""
        mark = self.between.strip(" ")
        apart = [p for p in new if not mark or mark in p or p.isspace()]
        joined = list(new.difference(apart)) if apart else list(new)
        for low in range(0, len(joined), 64 * JOINED):
            groups = [joined[k: k + JOINED] for k in range(low, min(low + 64 * JOINED, len(joined)), JOINED)]
            for group, found in zip(groups, self._ids([self.between.join(g) for g in groups])):
                ends = [*np.flatnonzero(found == self.mark).tolist(), len(found)]
                if len(ends) != len(group):
                    apart += group
                    continue
                data, start, width = self._packed(found), 0, self.width
                for part, end in zip(group, ends):
                    self.memo[part] = data[start * width: end * width]
                    start = end + 1
        for low in range(0, len(apart), 4096):
            some = apart[low: low + 4096]
            for part, found in zip(some, self._ids(some)):
                self.memo[part] = self._packed(found)


def text_encoder(path: str) -> TextEncoder:
    """This worker's encoder for a tokenizer file, which must be on every node."""
    return worker_local(("encoder", path), lambda: TextEncoder(path))

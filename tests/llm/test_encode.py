"""The encoder's memo, and the fixed-width fields of token files."""

import numpy as np
import public_tokenizers
import pytest

from glossaframe.llm import encode, token_files


class Counted(str):
    """A stretch that counts how often tables look for it."""

    looked = 0

    def __hash__(self):
        Counted.looked += 1
        return super().__hash__()

    __eq__ = str.__eq__


def whole(encoder, text):
    return np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


TEXTS = ["some words and some more words", "words, and\nsome lines", "", None, "two  blanks\tand \xa0 others\x85", "a­soft hyphen \U0001f468‍\U0001f469 here"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_known_stretches_are_looked_for_once(name):
    encoder = encode.TextEncoder(public_tokenizers.path(name))
    expected = [whole(encoder, t or "") for t in TEXTS]
    assert encoder.encode(TEXTS) == expected
    cut, Counted.looked = encoder.cut, 0
    encoder.cut = lambda text: [Counted(s) for s in cut(text)]
    assert encoder.encode(TEXTS) == expected
    assert Counted.looked == sum(len(cut(t or "")) for t in TEXTS)


def test_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(encode, "MOST_KEPT", 5)
    encoder = encode.TextEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):
        for text in TEXTS:
            assert encoder.encode([text, text]) == [whole(encoder, text or "")] * 2


@pytest.mark.parametrize("text", [" a", "a ", "a  b", "a\n", "\n", "a\tb", "a\xa0b", "a\x85b", "a\x1cb", "a\0b", "a b"])
def test_singly_spaced(text):
    words = text.split()
    gaps = text.count(" ") + text.count("\n")
    assert encode._singly_spaced(text) == (len(words) == gaps + 1 and len(text) == gaps + sum(map(len, words)) and "\0" not in text)


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_whole_bytes(bits):
    ids = np.random.default_rng(1).integers(0, 1 << bits, 1000, dtype=np.uint64).astype("<u4")
    fields = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    assert token_files.pack(ids, bits) == np.packbits(fields, bitorder="little").tobytes()
    assert (token_files.unpack(token_files.pack(ids, bits), bits, len(ids)) == ids).all()


@pytest.mark.parametrize("texts", [[], [None], ["", None, " a", "a  b", "a b, a", "a\tb", "x\0y z", "a\n\nb", "é ü\n中 文", ".,\n"], ["a b\nc", "b a"]])
def test_distinct_stretches_are_those_of_each_text(texts):
    distinct, places = encode.distinct_led_by_space(texts)
    assert [[distinct[k] for k in own] for own in places] == [encode.led_by_space(t or "") for t in texts]
    assert len(set(distinct)) == len(distinct)

import random

import numpy as np
import pytest

from quillon.llm.tokens import Encoder, vocabulary

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def library(e, text):
    return e.library.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module", params=NAMES)
def enc(request):
    return Encoder(vocabulary(request.param))


def test_mode(enc):
    assert enc.mode in ("byte", "word")


def test_every_low_code_point_and_white_space(enc):
    rng = random.Random(1)
    codes = [c for c in [*range(1, 0x250), *range(0x2000, 0x2070), 0x3000, 0x4E2D, 0x430, 0x1F600, 0x301, 0xFEFF] if not 0xD800 <= c < 0xE000]
    for c in codes:
        for text in (f"a{chr(c)}b c{chr(c)} {chr(c)}d's\n{chr(c)}x", f"{chr(c)}q"):
            assert list(np.frombuffer(enc.ids(text), "<u4")) == library(enc, text), hex(c)
    for _ in range(1500):
        text = "".join(rng.choice(["the", " ", "\n", "'s", "'", "é", "12", "!", ",", "\t", "X", "\r", " a", "中", "<|endoftext|>", "\xa0", "́", "\x1c", "I'll"]) for _ in range(rng.randint(0, 12)))
        assert list(np.frombuffer(enc.ids(text), "<u4")) == library(enc, text), repr(text)


def test_none_empty_and_long(enc):
    assert enc.ids(None) == enc.ids("") == b""
    text = "x" * 5000 + " the and" * 3000
    assert list(np.frombuffer(enc.ids(text), "<u4")) == library(enc, text)


def test_every_vocabulary_entry(enc):
    """Each entry alone and between words; merges by ranks and by the library could differ where an entry can't be built from its parts."""
    back = {c: b for b, c in enc.letters.items()}
    entries = [t.removesuffix("</w>") for t in enc.library.get_vocab()]
    texts = [t for e in entries for w in [bytes(back.get(c, 63) for c in e).decode("utf-8", "replace")] for t in (w, f"so {w} it")]
    for text, want in zip(texts, enc.library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert enc.ids(text) == np.array(want.ids, "<u4").tobytes(), repr(text)

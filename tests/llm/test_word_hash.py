from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from peerlens.llm.word_hash import PLACES, hash_words


def words(t: bytes) -> list[bytes]:
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in t)) if w]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.one_of(st.none(), st.text("aAbB \t\n\r\x0bé\x00zZ\x1f", max_size=12), st.integers(60, 200).map(lambda n: "xY" * n + " x" + "é" * n)), max_size=8), st.integers(0, 3))
def test_equal_words_have_equal_hashes(texts, cut):
    raw = [None if t is None else t.encode() for t in texts]
    h, n = hash_words(pa.array(raw, pa.binary()).slice(cut))
    want = [words(t or b"") for t in raw[cut:]]
    flat = [w for x in want for w in x]
    assert n.tolist() == [len(x) for x in want] and len(h) == len(flat)
    by = {}
    for w, x in zip(flat, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_hashes_differ_and_are_spread():
    many = [f"{a}{b}" for a in "abcdefgh" for b in range(20_000)] + ["a" * i for i in range(1, 3 * PLACES)] + ["a" * i + "b" for i in range(3 * PLACES)]
    h, n = hash_words(pa.array([" ".join(many).encode()], pa.binary()))
    assert n.tolist() == [len(many)] and len(np.unique(h)) == len(many)
    assert abs(np.unpackbits(h.view(np.uint8)).mean() - 0.5) < 0.01
    assert hash_words(pa.array([], pa.binary()))[0].tolist() == [] == hash_words(pa.array([b"", None, b"  "], pa.binary()))[0].tolist()

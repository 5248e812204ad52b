"""64-bit hashes of the words of many texts, a whole batch at a time.

Every byte at its place in its word gives a random 64-bit number, and a word's hash is the sum of these, spread once more. Nothing is made for each word but its hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .mph import mix

_GOLD = np.uint64(0x9E3779B97F4A7C15)
SPACE, PLACES = 32, 64
#: White space (space, tab to carriage return) as a space, A-Z lower-cased, all other bytes as they are.
LOWER = np.array([SPACE if x == 32 or 9 <= x <= 13 else x + 32 if 65 <= x <= 90 else x for x in range(256)], np.uint8)


def _number(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(mix(place.astype(np.uint64) + _GOLD) + byte.astype(np.uint64) * _GOLD)


def _table() -> np.ndarray:
    """For each of the first places and each byte; spaces count nothing."""
    t = _number(np.tile(np.arange(256), PLACES), np.repeat(np.arange(PLACES), 256))
    t[SPACE::256] = 0
    return t


TABLE = _table()


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary array's bytes, and where each text ends among them; null is empty."""
    if texts.null_count:
        texts = texts.fill_null(b"")
    wide = pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def hash_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of binary texts, one after the other, and how many each text has."""
    data, ends = raw_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    data = LOWER[data]
    word = data != SPACE
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = np.r_[0, ends[:-1]]
    heads = heads[heads < len(data)]
    first[heads] |= word[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    place = np.arange(len(data), dtype=np.int32)
    begin = np.zeros(len(data), np.int32)
    begin[starts] = starts
    place -= np.maximum.accumulate(begin)
    far = np.flatnonzero(word & (place >= PLACES))
    index = np.minimum(place, PLACES - 1) * np.int32(256) + data
    numbers = TABLE[index]
    if len(far):
        numbers[far] = _number(data[far], place[far])
    return mix(np.add.reduceat(numbers, starts)), np.diff(np.searchsorted(starts, np.r_[0, ends]))

"""Minimal perfect hash over 64-bit keys, from levels of bits with ranks.

On each level the keys left are hashed into a bit array; those that are alone at their bit are placed there, the others go to
the next level. The number of set bits before a key's bit is its slot. Building and probing handle whole arrays at a time.
"""

from __future__ import annotations

import numpy as np

LEVELS = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)


def build(keys: np.ndarray, gamma: float = 1.7) -> dict[str, np.ndarray]:
    """Arrays of the hash: words (bits of all levels), ranks (set bits before each word), sizes (bits of each level). Keys must be distinct."""
    left, bits, sizes = keys.astype(np.uint64), [], []
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("keys aren't distinct")
        size = -(-int(gamma * len(left) + 1) // 64) * 64
        at = _places(left, len(sizes), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        bits.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        left = left[~alone[at]]
    words = np.concatenate(bits) if bits else np.zeros(0, np.uint64)
    ones = np.bitwise_count(words).astype(np.int64)
    return {"words": words, "ranks": (np.cumsum(ones) - ones).astype(np.uint32), "sizes": np.array(sizes, np.int64)}


def slots(index: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key; -1, or a slot of another key, for keys that aren't in the set."""
    keys = keys.astype(np.uint64)
    out, live, offset = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(index["sizes"].tolist()):
        at = _places(keys[live], level, size)
        word, bit = (offset + (at >> np.uint64(6))).astype(np.int64), at & np.uint64(63)
        w = index["words"][word]
        hit = (w >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(w & ((np.uint64(1) << bit) - np.uint64(1)))
        out[live[hit]] = (index["ranks"][word] + below)[hit]
        live, offset = live[~hit], offset + size // 64
        if not len(live):
            break
    return out

"""MD5 of many short messages at a time: the rounds run over arrays, one element for each message."""

from __future__ import annotations

import numpy as np

# Shifts of the rounds, initial state.
SHIFTS = (7, 12, 17, 22) * 4 + (5, 9, 14, 20) * 4 + (4, 11, 16, 23) * 4 + (6, 10, 15, 21) * 4
STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: By rule: the fraction of the sine of 1 to 64.
SINES = [int(x) for x in np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64)]
#: Which word of a block each step takes.
WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
#: Messages at a time, so that the arrays stay in a core's cache.
CHUNK = 1 << 15


def _block(state: list[np.ndarray], m: list[np.ndarray]) -> list[np.ndarray]:
    """State after one block; m: 16 words of each message, one number where all messages have the same. The steps write into the arrays that they don't need any more."""
    (a, b, c, d), f, t = (x.copy() for x in state), np.empty_like(state[0]), np.empty_like(state[0])
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        w = m[WORDS[i]]
        if w.ndim:
            f += np.uint32(SINES[i])
            f += w
        else:
            f += np.uint32((SINES[i] + int(w)) & 0xFFFFFFFF)
        np.left_shift(f, np.uint32(SHIFTS[i]), out=t)
        f >>= np.uint32(32 - SHIFTS[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


def digests(messages: np.ndarray) -> list[np.ndarray]:
    """The four words of the MD5 of each row of bytes; all rows have the same length."""
    n, length = messages.shape
    size = -(-(length + 9) // 64) * 64
    out: list[list[np.ndarray]] = [[], [], [], []]
    for k in range(0, n, CHUNK):
        own = messages[k : k + CHUNK]
        raw = np.zeros((len(own), size), np.uint8)
        raw[:, :length] = own
        raw[:, length] = 0x80
        raw[:, -8:] = np.frombuffer((8 * length).to_bytes(8, "little"), np.uint8)
        words = np.ascontiguousarray(raw.view("<u4").T).reshape(size // 64, 16, len(own))
        state = [np.full(len(own), s, np.uint32) for s in STATE]
        for m in words:
            state = _block(state, [w[0] if (w == w[0]).all() else w for w in m])
        for o, s in zip(out, state, strict=True):
            o.append(s)
    return [np.concatenate(o) if o else np.zeros(0, np.uint32) for o in out]


def leading_bits(messages: np.ndarray, bits: int = 52) -> np.ndarray:
    """The first bits (33 to 64, in whole hexadecimal digits) of the digests as numbers."""
    a, b = (x.byteswap().astype(np.uint64) for x in digests(messages)[:2])
    return ((a << np.uint64(bits - 32)) | (b >> np.uint64(64 - bits))).astype(np.int64)

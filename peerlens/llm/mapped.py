"""Arrays in files of the shared folder that workers map into memory."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

_OPEN: dict[str, dict[str, np.ndarray]] = {}


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes a new file and renames it: a task that runs again, or twice at a time, leaves the same whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    at, head = 0, {}
    for k, a in arrays.items():
        head[k] = [at, a.dtype.str, len(a)]
        at += -(-a.nbytes // 64) * 64
    h = json.dumps(head).encode()
    h += b" " * (-(len(h) + 8) % 64)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(len(h).to_bytes(8, "little") + h)
        for a in arrays.values():
            f.write(memoryview(np.ascontiguousarray(a)).cast("B") if len(a) else b"")
            f.write(b"\0" * (-a.nbytes % 64))
        f.flush()
        os.fsync(f.fileno())
    os.replace(own, path)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays as read-only maps; the pages are shared by all workers of a machine. A worker keeps its maps open."""
    if path not in _OPEN:
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view("<u8")[0])
        head = json.loads(bytes(raw[8 : 8 + n]))
        out = {}
        for k, (at, kind, length) in head.items():
            start = 8 + n + at
            out[k] = np.asarray(raw[start : start + length * np.dtype(kind).itemsize].view(kind))  # a plain array: the map itself is slow to index
        if len(_OPEN) > 4096:
            _OPEN.clear()
        _OPEN[path] = out
    return _OPEN[path]

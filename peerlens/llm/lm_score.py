"""Scores of an interpolated modified Kneser-Ney model, counted in Spark and mapped into memory by workers.

The model has any order from 2. The highest order counts occurrences; the lower ones count how many different words stand before a run of words, except that
runs at the start of a text, which nothing can stand before, keep their occurrences. A context that isn't known leaves the probability to the next lower order.

Counting goes through blocks: a task counts what it has read, sorts it, and sends one compressed block to each shard; a
shard's task merges its blocks into sorted arrays in a file of the shared folder. A frequent word or run of words is one
entry in each block, so no shard grows with it, and the number of shards grows with the corpus. Each order is counted in passes over ranges of shards, so that only a
part of its blocks is on disk at a time.

Words are known by 64-bit hashes (word_hash.py); a word's id is its place among the sorted hashes, and ids are packed into as many bits as they need. Runs of words are looked up by
64-bit hashes of their ids, of which sorted arrays keep 40 bits; the others follow from the place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mapped
from .common import forget, local_path, pick, release, slices, workspace, written
from .mph import mix
from .word_hash import hash_words

#: Hash of the token that ends each text; id of a word that the model doesn't know.
END, UNKNOWN = 0x0E4D0F7E, -1
BLOCK = "level int, shard bigint, payload binary"
_CODEC = "zstd"
_HALF, _32 = np.uint64(0xFFFFFFFF), np.uint64(32)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed bytes; the first, which ascends, as differences. Bytes of equal weight stand together."""
    out = [len(arrays[0]).to_bytes(8, "little")]
    for k, a in enumerate(arrays):
        a = a.astype(np.uint64)
        a = np.diff(a, prepend=np.uint64(0)) if k == 0 else a
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T)
        c = pa.compress(planes.tobytes(), _CODEC, asbytes=True)
        out += [len(c).to_bytes(8, "little"), c]
    return b"".join(out)


def _unpack(raw: bytes) -> list[np.ndarray]:
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        planes = np.frombuffer(pa.decompress(raw[at + 8 : at + 8 + size], n * 8, _CODEC, asbytes=True), np.uint8).reshape(8, n)
        a = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
        out.append(np.cumsum(a, dtype=np.uint64) if not out else a)
        at += 8 + size
    return out


def _merge(blocks: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Blocks of (keys, counts...) as one: distinct ascending keys with the sums of their counts."""
    if not blocks:
        return []
    keys, *counts = (np.concatenate(x) for x in zip(*blocks, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return [keys[first], *[np.add.reduceat(c[order], first) if len(first) else c for c in counts]]


def _range_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard of 64-bit numbers by their size: shards are consecutive ranges."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _by_shard(shard: np.ndarray) -> np.ndarray:
    """Order by shard that keeps the order within each; small numbers are sorted digit by digit."""
    return np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")


def _send(keys: np.ndarray, shard: np.ndarray, *counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = _by_shard(shard)
    s = shard[order]
    edges = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True]) if len(s) else []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        own = order[i:j]
        yield int(s[i]), _pack(keys[own], *[c[own] for c in counts])


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"level": pa.array([r[0] for r in rows], pa.int32()), "shard": pa.array([r[1] for r in rows], pa.int64()), "payload": pa.array([r[2] for r in rows], pa.binary())})


def _blocks(level: int, rows: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for shard, payload in rows:
        yield from _rows([(level, shard, payload)]).to_batches()


def _texts(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token hashes of whole texts, each with END after it, and the texts' lengths; about so many tokens at a time."""
    kept, lengths, size = [], [], 0
    for batch in slices(batches, "text", 500):
        hashes, n = hash_words(batch.column("text"))
        n = n + 1
        out = np.empty(int(n.sum()), np.uint64)
        ends = np.cumsum(n) - 1
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[ends] = END
        out[inner] = hashes
        kept.append(out)
        lengths.append(n)
        size += len(out)
        if size >= tokens:
            yield np.concatenate(kept), np.concatenate(lengths)
            kept, lengths, size = [], [], 0
    if kept:
        yield np.concatenate(kept), np.concatenate(lengths)


def _padded(ids: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts with `start` before each, and each one's place in its text (0 for start)."""
    first = np.cumsum(lengths) - lengths
    out = np.insert(ids, first, start)
    return out, np.arange(len(out)) - np.repeat(first + np.arange(len(first)), lengths + 1)


def _columns(ids: np.ndarray, ends: np.ndarray, k: int) -> list[np.ndarray]:
    """The k ids up to each end."""
    return [ids[ends - k + 1 + i].astype(np.uint64) for i in range(k)]


def _packed(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Columns of ids of so many bits in as few columns as hold them; the order of rows stays the same."""
    per = max(1, 64 // bits)
    return [reduce(lambda x, y: (x << np.uint64(bits)) | y, columns[i : i + per]) for i in range(0, len(columns), per)]


def _unpacked(packed: list[np.ndarray], bits: int, k: int) -> list[np.ndarray]:
    per, out = max(1, 64 // bits), []
    for i, x in enumerate(packed):
        n = min(per, k - i * per)
        out += [(x >> np.uint64(bits * (n - 1 - j))) & np.uint64((1 << bits) - 1) for j in range(n)]
    return out


def _ascending(packed: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their columns; equal rows in any order. Each further column is sorted together with the place of what stands before it among the distinct."""
    order = np.argsort(packed[0])
    before = packed[0][order]
    for c in packed[1:]:
        place = np.cumsum(np.r_[False, before[1:] != before[:-1]]).astype(np.uint64) if len(before) else before
        bits = int(c.max()).bit_length() if len(c) else 0
        if len(place) and int(place[-1]).bit_length() + bits > 64:
            return np.lexsort(packed[::-1])
        before = (place << np.uint64(bits)) | c[order]
        by = np.argsort(before)
        order, before = order[by], before[by]
    return order


def _distinct(packed: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in ascending order, with the sums of their counts."""
    order = _ascending(packed)
    packed = [c[order] for c in packed]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in packed:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in packed], np.add.reduceat(counts[order], first) if len(first) else counts


def _context_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of all but the last id of runs."""
    return reduce(lambda h, c: mix(h * _GOLD + c + np.uint64(1)), columns[1:-1], mix(columns[0] + np.uint64(1)))


def _place(hashes: np.ndarray, shards: int, buckets: int) -> np.ndarray:
    """Bucket of hashes of one shard: equal parts of the shard's range, in ascending order."""
    within = ((hashes >> _32) * np.uint64(shards)) & _HALF
    return ((within * np.uint64(buckets)) >> _32).astype(np.int64)


def _keys(name: str, hashes: np.ndarray, shards: int) -> dict[str, np.ndarray]:
    """Ascending distinct hashes of a shard: 40 bits of each, and where each bucket begins."""
    buckets = len(hashes) // 6 + 1
    begin = np.searchsorted(_place(hashes, shards, buckets), np.arange(buckets + 1))
    return {f"{name}_low": hashes.astype(np.uint32), f"{name}_high": (hashes >> _32).astype(np.uint8), f"{name}_at": begin.astype(np.min_scalar_type(len(hashes)))}


def _find(a: dict[str, np.ndarray], name: str, hashes: np.ndarray, shards: int, together: int = 1 << 16) -> np.ndarray:
    """Places of hashes among the keys of a shard, -1 for those that aren't there; the buckets of so many hashes are read at a time."""
    out = np.full(len(hashes), -1, np.int64)
    for i in range(0, len(hashes), together):
        h = hashes[i : i + together]
        bucket = _place(h, shards, len(a[f"{name}_at"]) - 1)
        at = a[f"{name}_at"][bucket].astype(np.int64)
        sizes = a[f"{name}_at"][bucket + 1].astype(np.int64) - at
        upto = np.cumsum(sizes)
        # The buckets' places one after the other, compared by their low bits first.
        places = np.repeat(at - upto + sizes, sizes)
        places += np.arange(len(places))
        same = np.flatnonzero(a[f"{name}_low"][places] == np.repeat(h.astype(np.uint32), sizes))
        places, own = places[same], np.searchsorted(upto, same, side="right")
        high = a[f"{name}_high"][places] == (h[own] >> _32).astype(np.uint8)
        out[i + own[high][::-1]] = places[high][::-1]  # the first one counts
    return out


def _numbers(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers as bytes; those from 255 on stand in a list of their own."""
    big = np.flatnonzero(values >= 255)
    return {name: np.minimum(values, 255).astype(np.uint8), f"{name}_where": big.astype(np.uint64), f"{name}_big": values[big].astype(np.uint64)}


def _value(a: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    out = a[name][at].astype(np.float64)
    big = np.flatnonzero(out == 255)
    if len(big):
        out[big] = a[f"{name}_big"][np.searchsorted(a[f"{name}_where"], at[big].astype(np.uint64))]
    return out


@dataclass
class Model:
    """Where the arrays are, and the few numbers that hold for all of them."""

    path: str
    words: int = 1  # ranges of words
    shards: int = 1  # ranges of contexts
    order: int = 2
    bases: list[int] = field(default_factory=list)  # id of the first word of each range
    full: dict[int, frozenset[int]] = field(default_factory=dict)  # by length of run: shards that have any
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)  # by length of run
    tokens: int = 0
    types: int = 0
    continuations: int = 0
    word_kinds: tuple[int, int, int] = (0, 0, 0)  # words with 1, 2, 3 or more continuations

    @property
    def start(self) -> int:
        """Id of the context before a text's first token."""
        return self.types

    @property
    def bits(self) -> int:
        return max(1, self.types.bit_length())

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of ascending word hashes, UNKNOWN for those that aren't in the training texts."""
        out = np.full(len(hashes), UNKNOWN, np.int64)
        for s, i, j in self._ranges(_range_of(hashes, self.words)):
            if s in self.full[1]:
                keys = mapped.load(f"{self.path}/words/{s}")["keys"]
                at = np.minimum(np.searchsorted(keys, hashes[i:j]), len(keys) - 1)
                out[i:j] = np.where(keys[at] == hashes[i:j], at + self.bases[s], UNKNOWN)
        return out

    @staticmethod
    def _ranges(shard: np.ndarray) -> list[tuple[int, int, int]]:
        edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]).tolist() if len(shard) else []
        return [(int(shard[i]), i, j) for i, j in zip(edges[:-1], edges[1:], strict=True)]

    def owner(self, ids: np.ndarray) -> np.ndarray:
        """Range of each word."""
        return np.searchsorted(self.bases, ids, side="right") - 1

    def of_words(self, ids: np.ndarray, kind: str) -> np.ndarray:
        """The words' numbers for ascending ids; 0 for UNKNOWN."""
        out, known = np.zeros(len(ids)), np.flatnonzero(ids >= 0)
        for s, i, j in self._ranges(self.owner(ids[known])):
            own = known[i:j]
            out[own] = _value(mapped.load(f"{self.path}/{kind}/{s}"), "counts", ids[own] - self.bases[s])
        return out

    def word_probability(self, continuations: np.ndarray) -> np.ndarray:
        """Lowest order: discounted share of the contexts a word follows, interpolated with the same share for all types and one unknown."""
        if not self.continuations:
            return np.full(len(continuations), 1 / (self.types + 1))
        rest = sum(d * n for d, n in zip(self.discounts[1], self.word_kinds, strict=True)) / self.continuations
        return _discounted(continuations, self.discounts[1]) / self.continuations + rest / (self.types + 1)

    def score(self, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: known tokens, base score, log10 probability."""
        first = np.cumsum(lengths) - lengths
        uniq, inv = np.unique(hashes, return_inverse=True)
        uid = self.ids(uniq)
        raw = self.of_words(uid, "words")
        base = np.log10((raw + 1) / (self.tokens + 1 * (self.types + 1)))[inv]
        known = (raw > 0)[inv]
        p = self.word_probability(self.of_words(uid, "conts") if self.tokens else raw)[inv]
        seq, place = _padded(uid[inv], lengths, self.start)
        for k in range(2, self.order + 1):
            p = self.longer(k, seq, place, p)
        add = lambda x: np.add.reduceat(x, first) if len(first) else x
        return add(known.astype(np.int64)), add(base), add(np.log10(p))

    def longer(self, k: int, seq: np.ndarray, place: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities by runs of k words where the k - 1 words before are known, else the lower order's; one for each token of padded texts."""
        token, ends = np.cumsum(place > 0) - 1, np.flatnonzero(place >= k - 1)
        for i in range(1, k):
            ends = ends[seq[ends - i] >= 0]
        if not len(ends) or not self.tokens:
            return lower
        columns = _columns(seq, ends, k)
        context = _context_hash(columns)
        key = mix(context * _GOLD + columns[-1] + np.uint64(1))
        # Each context is looked up once, and both contexts and keys in ascending order, so that neighbours in the arrays follow each other.
        kinds, of = np.unique(context, return_inverse=True)
        shard = _range_of(kinds, self.shards)
        sums, rests = np.zeros(len(kinds)), np.zeros(len(kinds))
        for s, i, j in self._ranges(shard):
            if s in self.full[k]:
                a = mapped.load(f"{self.path}/runs{k}/{s}")
                at = _find(a, "contexts", kinds[i:j], self.shards)
                own, at = i + np.flatnonzero(at >= 0), at[at >= 0]
                sums[own] = _value(a, "total", at)
                rests[own] = sum(d * _value(a, n, at) for d, n in zip(self.discounts[k], ("one", "two", "more"), strict=True))
        count, total, rest = np.zeros(len(ends)), sums[of], rests[of]
        order = np.argsort(key)
        order = order[(total[order] > 0) & (seq[ends[order]] >= 0)]
        where = shard[of[order]]
        by = _by_shard(where)
        order = order[by]
        for s, i, j in self._ranges(where[by]):
            a, own = mapped.load(f"{self.path}/runs{k}/{s}"), order[i:j]
            at = _find(a, "keys", key[own], 1)
            count[own[at >= 0]] = _value(a, "counts", at[at >= 0])
        ok = total > 0
        out, t = lower.copy(), token[ends[ok]]
        out[t] = (_discounted(count[ok], self.discounts[k]) + rest[ok] * lower[t]) / total[ok]
        return out


def _discounted(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *discounts])[np.minimum(counts, 3).astype(np.int64)], 0)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts of 1, 2, 3 or more, from how many things have a count of 1, 2, 3, 4; each at least 0 and at most its count. 0.5, 1, 1.5 where a number needed is missing."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else (k + 1) / 2 for k in range(3)]
    return tuple(min(max(x, 0.0), k + 1.0) for k, x in enumerate(d))  # type: ignore[return-value]


def train(spark: SparkSession, docs: DataFrame, word_bytes: int = 64 << 20, pair_bytes: int = 24 << 20, buffer: int = 3_000_000, order: int = 2, passes: int = 2) -> Model:
    """Counts the words of the column `text` (binary) of docs: a range of words for each word_bytes, one of contexts for each pair_bytes of text."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()
    at = workspace(spark)
    model = Model(local_path(at), max(1, -(-size[0] // word_bytes)), max(1, -(-size[0] // pair_bytes)), order)
    tokens = docs.select("text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, _ in _texts(batches, buffer):
            keys, counts = np.unique(hashes, return_counts=True)
            yield from _blocks(1, _send(keys, _range_of(keys, model.words), counts))
        release()

    def merge_words(key: tuple, t: pa.Table) -> pa.Table:
        keys, counts = _merge([_unpack(x) for x in t.column("payload").to_pylist()])
        mapped.save(f"{model.path}/words/{key[0].as_py()}", {"keys": keys, **_numbers("counts", counts)})
        return pa.table({"shard": [key[0].as_py()], "types": [len(keys)], "tokens": [int(counts.sum())]})

    merged = written(spark, tokens.mapInArrow(count_words, BLOCK).groupBy("shard").applyInArrow(merge_words, "shard bigint, types bigint, tokens bigint"), f"{at}/sizes")
    found = {r[0]: (r[1], r[2]) for r in merged.collect()}  # one row for each range of words
    for s in range(model.words):
        model.bases.append(model.types)
        model.types += found.get(s, (0, 0))[0]
        model.tokens += found.get(s, (0, 0))[1]
    model.full[1] = frozenset(found)
    if not model.tokens:
        return model
    bits, start = model.bits, model.start

    def send_runs(columns: list[np.ndarray], counts: np.ndarray, low: int = 0, high: int = 1 << 62) -> Iterator[tuple[int, bytes]]:
        """Runs of two words or more to the shard of their context, as far as that is in the range; single words to their own range."""
        shard = _range_of(_context_hash(columns), model.shards) if len(columns) > 1 else model.owner(columns[0].astype(np.int64))
        own = (shard >= low) & (shard < high)
        packed, counts = _distinct(_packed([c[own] for c in columns], bits), counts[own])
        columns = _unpacked(packed, bits, len(columns))
        shard = _range_of(_context_hash(columns), model.shards) if len(columns) > 1 else model.owner(columns[0].astype(np.int64))
        yield from _send(packed[0], shard, *packed[1:], counts)

    def count_runs(low: int, high: int):
        """Runs of `order` words; of a text that is shorter, with its start, all of it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for hashes, lengths in _texts(batches, buffer):
                uniq, inv = np.unique(hashes, return_inverse=True)
                seq, place = _padded(model.ids(uniq)[inv], lengths, start)
                del uniq, inv
                last = np.cumsum(lengths + 1) - 1
                for k in range(2, order + 1):
                    ends = np.flatnonzero(place >= k - 1) if k == order else last[lengths + 1 == k]
                    if len(ends):
                        yield from _blocks(k, send_runs(_columns(seq, ends, k), np.ones(len(ends), np.int64), low, high))
            release()

        return run

    def merge_runs(k: int):
        def run(key: tuple, t: pa.Table) -> pa.Table:
            level, s = key[0].as_py(), key[1].as_py()
            payloads = t.column("payload").to_pylist()
            if level < k:  # of a later turn
                return _rows([(level, s, x) for x in payloads])
            *packed, counts = (np.concatenate(x) for x in zip(*[_unpack(x) for x in payloads], strict=True))
            del payloads
            packed, counts = _distinct(packed, counts)
            columns = _unpacked(packed, bits, k)
            context = _context_hash(columns)
            keys = mix(context * _GOLD + columns[-1] + np.uint64(1))
            by = np.argsort(keys)
            out = _keys("keys", keys[by], 1) | _numbers("counts", counts[by])
            by = np.argsort(context)
            first = np.flatnonzero(np.r_[True, np.diff(context[by]) > 0])
            c = counts[by]
            out |= _keys("contexts", context[by][first], model.shards)
            for name, w in (("total", c), ("one", c == 1), ("two", c == 2), ("more", c >= 3)):
                out |= _numbers(name, np.add.reduceat(w.astype(np.int64), first))
            mapped.save(f"{model.path}/runs{k}/{s}", out)
            rows = [(0, s, np.array([np.count_nonzero(counts == n) for n in (1, 2, 3, 4)], np.int64).tobytes())]
            del context, keys, by, first, c, out
            rows += [(k - 1, x, p) for x, p in send_runs(columns[1:], np.ones(len(counts), np.int64))]
            if k > 2:
                own = columns[0] == start
                rows += [(k - 1, x, p) for x, p in send_runs([c[own] for c in columns[:-1]], counts[own])]
            release()
            return _rows(rows)

        return run

    edges = [model.shards * i // passes for i in range(passes + 1)]
    ranges, made = [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b], None
    for k in range(order, 1, -1):
        parts = []
        for i, (low, high) in enumerate(ranges):
            blocks = tokens.mapInArrow(count_runs(low, high), BLOCK) if made is None else made.where(f"level = {k} and shard >= {low} and shard < {high}")
            if made is not None and i == 0:
                blocks = blocks.unionAll(made.where(f"level > 0 and level < {k}"))
            parts.append(written(spark, blocks.groupBy("level", "shard").applyInArrow(merge_runs(k), BLOCK), f"{at}/level{k}/{i}"))
        above, made = made, reduce(DataFrame.unionAll, parts)
        numbers = made.where("level = 0")
        model.full[k] = frozenset(r[0] for r in numbers.select("shard").collect())  # one row for each shard
        model.discounts[k] = discounts(_sum_of(numbers)) if model.full[k] else (0.5, 1.0, 1.5)
        if above is not None:
            forget(spark, f"{at}/level{k + 1}")

    def merge_continuations(key: tuple, t: pa.Table) -> pa.Table:
        s = key[0].as_py()
        ids, counts = _merge([_unpack(x) for x in t.column("payload").to_pylist()])
        c = np.zeros(found[s][0], np.int64)
        c[ids.astype(np.int64) - model.bases[s]] = counts
        mapped.save(f"{model.path}/conts/{s}", _numbers("counts", c))
        numbers = [int(c.sum()), *[int(np.count_nonzero(c == k)) for k in (1, 2, 3, 4)], int(np.count_nonzero(c >= 3))]
        return pa.table({"payload": pa.array([np.array(numbers, np.int64).tobytes()], pa.binary())})

    total, n1, n2, n3, n4, more = _sum_of(made.where("level = 1").groupBy("shard").applyInArrow(merge_continuations, "payload binary"))
    forget(spark, f"{at}/level2")
    model.continuations, model.word_kinds, model.discounts[1] = total, (n1, n2, more), discounts([n1, n2, n3, n4])
    return model


def _sum_of(rows: DataFrame) -> list[int]:
    """Sum of the short rows of numbers, one from each shard."""
    return np.sum([np.frombuffer(r[0], np.int64) for r in rows.select("payload").collect()], axis=0).tolist()


def score_documents(spark: SparkSession, docs: DataFrame, held_out: Column, order: int = 2, **sizes: int) -> DataFrame:
    """Trains a model of this order on the rows where held_out (over doc_id and text) isn't true, and scores every row's whole text.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens that occur in training), train_tokens, base_score, score (log10 of the
    text's probability), perplexity (of its tokens). A null text is an empty one: just the end. A null in held_out means training. Repeated rows
    count and are scored each. Without any training text every token has probability 1. Texts are scored whole, about 3 MB at a time; a longer one is a
    batch of its own. Further columns are ignored.
    """
    d = pick(docs, doc_id="", text="string")
    d = d.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("binary").alias("text"))
    model = train(spark, d.where("not held_out"), order=order, **sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 500, 3 << 20):
            hashes, lengths = next(_texts(iter([batch]), 1 << 40))
            known, base, score = model.score(hashes, lengths)
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), model.tokens)), pa.array(base), pa.array(score), pa.array(10 ** (-score / lengths))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])
        release()

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")

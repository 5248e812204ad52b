"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is bound from its letters' vectors, each permuted by its place and
all multiplied; a text's vector bundles (adds) those of its n-grams, and a language's prototype bundles its training texts. The
language whose prototype has the largest cosine with the text's vector is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

UNDETERMINED = "und"
#: Code for whatever is no letter; runs of it count as one.
BREAK = 0


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, a BREAK for each run of other characters, and one at either end."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where(_letters()[c], c, BREAK)
    c = np.r_[BREAK, c, BREAK]
    return c[np.r_[True, (c[1:] != BREAK) | (c[:-1] != BREAK)]]


class Encoder:
    """Bundles of n-grams (n = 3) as vectors; letter vectors follow from the code point and the seed alone."""

    def __init__(self, dim: int, seed: int = 1, keep: int = 40_000):
        self.dim, self.seed, self.keep = dim, seed, keep
        self.letters: dict[int, np.ndarray] = {}
        self.grams = np.zeros((0, dim), np.int8)
        self.at: dict[int, int] = {}

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            if len(self.letters) > self.keep:
                self.letters.clear()
            self.letters[c] = np.random.Generator(np.random.Philox(key=[self.seed, c])).integers(0, 2, self.dim, np.int8) * 2 - 1
        return self.letters[c]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """int8 vectors of packed n-grams; those seen before are kept, up to `keep`."""
        if new := [g for g in grams.tolist() if g not in self.at]:
            if len(self.at) + len(new) > self.keep:
                self.at, self.grams, new = {}, np.zeros((0, self.dim), np.int8), grams.tolist()
            g = np.array(new, np.int64)
            made = np.ones((len(g), self.dim), np.int8)
            for place, part in enumerate((g >> 42, g >> 21, g)):
                uniq, inv = np.unique(part & 0x1FFFFF, return_inverse=True)
                made *= np.roll(np.stack([self.letter(c) for c in uniq.tolist()]), 2 - place, axis=1)[inv]
            self.at |= zip(new, range(len(self.at), len(self.at) + len(new)), strict=True)
            self.grams = np.concatenate([self.grams, made])
        return self.grams[[self.at[x] for x in grams.tolist()]]


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of all texts and the number of the text that each comes from. n-grams with a BREAK in the middle say little and are left out."""
    parts = [codes(t) for t in texts]
    c = np.concatenate([*parts, np.zeros(2, np.int64)])
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    g = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    ok = c[1:-1] != BREAK
    return g[ok], doc[ok[: len(doc)]] if len(doc) else doc


def distinct(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse; by a table of letters where there are few of them, else by sorting."""
    low = [g >> 42, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF]
    seen = np.zeros(0x110000, bool)
    for x in low:
        seen[x] = True
    alphabet = np.flatnonzero(seen)
    n = len(alphabet)
    if n > 128:
        return np.unique(g, return_inverse=True)
    to = np.zeros(0x110000, np.int32)
    to[alphabet] = np.arange(n)
    code = (to[low[0]] * n + to[low[1]]) * n + to[low[2]]
    used = np.zeros(n**3, bool)
    used[code] = True
    kinds = np.flatnonzero(used)
    number = np.zeros(n**3, np.int32)
    number[kinds] = np.arange(len(kinds))
    a, b, c = alphabet[kinds // (n * n)], alphabet[kinds // n % n], alphabet[kinds % n]
    return (a << 42) | (b << 21) | c, number[code]


def bundles(enc: Encoder, texts: list[str], owner: list[int], owners: int, most: int = 30_000) -> np.ndarray:
    """float64 sums of the n-gram vectors of each owner's texts; so many kinds of n-gram at a time bound the memory."""
    g, doc = packed(texts)
    out = np.zeros((owners, enc.dim))
    if not len(g):
        return out
    kinds, inv = distinct(g)
    key = np.array(owner, np.int64)[doc]
    for low in range(0, len(kinds), most):
        part = kinds[low : low + most]
        own = slice(None) if len(kinds) <= most else (inv >= low) & (inv < low + most)
        counts = np.bincount(key[own] * len(part) + (inv[own] - low), minlength=owners * len(part)).reshape(owners, -1)
        out += counts.astype(np.float32) @ enc.vectors(part).astype(np.float32)
    return out


def _chunks(texts: list[str], most: int = 400_000, rows: int = 256) -> Iterator[range]:
    """Ranges of at most so many texts with about so many characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > most or i - start >= rows):
            yield range(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield range(start, len(texts))


def train(docs: DataFrame, dim: int = 1024, seed: int = 1) -> DataFrame:
    """lang, vector (array<double>): prototypes from the columns text and lang. Rows with a null in either, and texts without letters, teach nothing.

    Each task adds up its texts by language; the sums of tasks, one row for each language and task, are added by Spark.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sums = Encoder(dim, seed), {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            names = sorted(set(langs))
            for r in _chunks(texts):
                made = bundles(enc, [texts[i] for i in r], [names.index(langs[i]) for i in r], len(names))
                for k in np.flatnonzero(made.any(axis=1)).tolist():
                    sums[names[k]] = sums.get(names[k], 0.0) + made[k]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "part"])

    parts = pick(docs, text="string", lang="string").dropna().mapInArrow(bundle, "lang string, part array<double>")
    each = parts.select("lang", F.posexplode("part").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    return each.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def predict(docs: DataFrame, prototypes: DataFrame, dim: int = 1024, seed: int = 1, most_languages: int = 10_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and the columns `keep` for every row of docs.

    The score is the cosine with the prototype, at least 0. Null texts, and those without letters, are "und" with score 0; so is everything if there is
    no prototype. Equal cosines go to the language first in the alphabet. Repeated rows stay; further columns are ignored.
    """
    rows = sorted(tuple(r) for r in prototypes.limit(most_languages + 1).collect())  # one short vector for each language
    if len(rows) > most_languages:
        raise ValueError(f"over {most_languages} languages")
    names = [r[0] for r in rows]
    proto = np.array([r[1] for r in rows], np.float64).reshape(len(rows), dim)
    proto = (proto / np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-300)).astype(np.float32)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(dim, seed)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            for r in _chunks(texts) if names else ():
                v = bundles(enc, [texts[i] for i in r], list(range(len(r))), len(r)).astype(np.float32)
                norm = np.linalg.norm(v, axis=1)
                cos = (v @ proto.T) / np.maximum(norm, 1e-30)[:, None]
                best[r.start : r.stop] = np.where(norm > 0, cos.argmax(axis=1), -1)
                score[r.start : r.stop] = np.where(norm > 0, cos.max(axis=1).clip(0, 1), 0)
            pred = [names[k] if k >= 0 else UNDETERMINED for k in best.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), *[batch.column(c) for c in keep]], ["doc_id", "lang_pred", "score", *keep])

    d = pick(docs, doc_id="", text="string", **dict.fromkeys(keep, "")).withColumn("text", F.coalesce("text", F.lit("")))
    kinds = ", ".join([f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double", *[f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keep]])
    return d.mapInArrow(judge, kinds)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0))

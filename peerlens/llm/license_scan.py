"""License scan: ordered signature rules, gated by keywords, with overlaps resolved by priority and containment.

Every rule has a word that all its matches contain; only the rules whose word a text has are tried on it. A detection goes where another one whose rule is of a class
before its own, or of the same class and with a longer span (or an equal one, earlier in the table), contains its span. Detections that overlap otherwise both stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, release, slices
from .license_rules import CLASSES, RULES, Rule

SPACE = 32
#: Bytes of words as they are (A-Z lower-cased, all past ASCII kept), a space for any other.
CANON = bytes(x if x >= 0x80 else ord(chr(x).lower()) if chr(x).isalnum() else SPACE for x in range(256))

FOUND = pa.struct([("label", pa.string()), ("kind", pa.string()), ("rule", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("from_byte", pa.int64()), ("to_byte", pa.int64())])
DETECTIONS = "array<struct<label:string,kind:string,rule:int,first:bigint,last:bigint,from_byte:bigint,to_byte:bigint>>"

Hit = tuple[int, int, Rule]


class Scanner:
    """Finds the rules' matches in one text after the other."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.gated: dict[bytes, list] = defaultdict(list)
        for r in rules:
            self.gated[r.gate.encode()].append((r, re.compile(r.spaced.encode())))
        self.gates = frozenset(self.gated)

    def hits(self, words: list[bytes]) -> list[Hit]:
        """(first word, last word, rule) of every match; a rule's own matches don't overlap."""
        open_ = self.gates.intersection(words)
        if not open_:
            return []
        text = b" " + b"  ".join(words) + b" "
        found = [(m.start(), m.end() - 1, r) for g in open_ for r, pattern in self.gated[g] for m in pattern.finditer(text)]
        if not found:
            return []
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == SPACE)  # two for each word
        at = np.searchsorted(spaces, np.array([(a, b) for a, b, _ in found])) // 2
        return [(int(a), int(b), r) for (a, b), (_, _, r) in zip(at, found, strict=True)]


def survivors(hits: list[Hit]) -> list[Hit]:
    """The hits without those that another one suppresses, by their place; hits of the class `base` always stay.

    Whatever contains a suppressed hit's suppressor contains that hit too, so it doesn't matter whether the suppressor itself stays.
    """
    out, firsts, lasts = [], [], []  # of all classes before the present one: first words, ascending, and the largest last word up to there
    for level in range(len(CLASSES)):
        own = sorted((h for h in hits if h[2].priority == level), key=lambda h: (h[0], -h[1], h[2].order))
        reach = -1
        for h in own:
            i = bisect_right(firsts, h[0])
            if h[2].kind == "base" or max(reach, lasts[i - 1] if i else -1) < h[1]:
                out.append(h)
            reach = max(reach, h[1])
        both = sorted([*zip(firsts, lasts, strict=True), *((a, b) for a, b, _ in own)])
        firsts, lasts = [a for a, _ in both], np.maximum.accumulate([b for _, b in both]).tolist() if both else []
    return sorted(out, key=lambda h: (h[0], -h[1], h[2].order))


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def scan_text(s: Scanner, text: bytes | None) -> tuple[int, list[dict]]:
    """Number of words, and the detections of a text in UTF-8 with spans in words and bytes (ends are not part of them, but `last` is)."""
    canon = (text or b"").translate(CANON)
    words = canon.split()
    hits = survivors(s.hits(words))
    if not hits:
        return len(words), []
    inside = np.r_[False, np.frombuffer(canon, np.uint8) != SPACE, False]
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    return len(words), [{"label": r.label, "kind": r.kind, "rule": r.order, "first": a, "last": b, "from_byte": int(starts[a]), "to_byte": int(ends[b])} for a, b, r in hits]


def scan_licenses(docs: DataFrame, rules: tuple[Rule, ...] = tuple(RULES)) -> DataFrame:
    """For each row: doc_id, n_words, and `detections` with label, class, rule, span in words (both ends) and in bytes of the UTF-8 text.

    Null and empty texts have no words and no detections. Texts are scanned whole, one at a time, so memory follows the longest one; a worker takes a few MB of texts
    at once. Rows are judged one by one: null, tied and repeated doc_ids stay. Further columns are ignored.
    """
    d = pick(docs, doc_id="", text="string").select("doc_id", F.col("text").cast("binary").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for b in slices(batches, "text"):
            each = [scan_text(s, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in each], pa.int64()), pa.array([x for _, x in each], pa.list_(FOUND))], ["doc_id", "n_words", "detections"])
        release()

    return d.mapInArrow(scan, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words bigint, detections {DETECTIONS}")


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, the places of base phrases (number, first and last word at which one starts), labels of the base and of all, and the confidence of the surest detection (0 without any)."""
    base = F.filter("detections", lambda x: x["kind"] == "base")
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda y: y["label"]))), ",")
    sure = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(F.transform(base, lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["first"])).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda x: sure[x["kind"]])), F.lit(0.0)).alias("score"), F.size("detections").cast("bigint").alias("n_detections"),
    )

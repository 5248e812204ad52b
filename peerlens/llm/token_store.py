"""Token ids in Parquet files: list columns with dictionary encoding, delta encoded metadata, bounded row groups, page indexes.

Files follow the order of the documents, so a range of documents is a range of row groups; metadata can be read without tokens.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Recent, few, pick, release, slices

#: Pages of so many bytes, in row groups of so many (see write_tokens()); delta encoding for the numbers that ascend or are small, a dictionary for token ids.
LAYOUT = {
    "parquet.page.size": str(64 << 10), "parquet.page.row.count.limit": "2000", "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(2 << 20), "compression": "zstd",
    **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "nth", "part_start", "n_tokens")},
}
SCHEMA = "doc_id bigint, part int, nth bigint, part_start bigint, n_tokens bigint, ids array<int>"

#: Stands between the ids of chunks.
GAP = b"\xff" * 4
#: Normalisers that treat what stands between spaces apart from the rest.
APART = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}
#: Latin letters, digits and marks: all up to here but white space. Nothing among them joins what stands before it.
LATIN = "".join(c for c in map(chr, range(0x250)) if c not in "\t\n\v\f\r \x85\xa0")
#: A pattern that takes letters that stand together as one word: a run of letters, after nothing but what begins with an apostrophe.
RUNS = re.compile(r"(?:'[a-z]+\|)*(?:\[\\p\{L\}\]|\\p\{L\})\+(?:\|.*)?", re.DOTALL)
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
#: The character that stands for each byte in a model of bytes, but for the space, which stays one.
BYTES = "".join(" " if b == 32 else chr(b if b in _SHOWN else 256 + _HIDDEN.index(b)) for b in range(256))


def cuts_at_spaces(tokenizer: Any) -> bool:
    """Whether a tokenizer takes what stands between spaces and line feeds apart from the rest: by its own description, white space is nothing but a gap between words."""
    d = json.loads(tokenizer.to_str())
    norm, pre = ((x or {}).get(k, [x]) for x, k in ((d["normalizer"], "normalizers"), (d["pre_tokenizer"], "pretokenizers")))
    gaps = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if d["post_processor"] or any(n and n != gaps and n["type"] not in APART for n in norm) or any(a["lstrip"] or a["rstrip"] or re.search(r"\s", a["content"]) for a in d["added_tokens"]):
        return False
    split = pre[0] or {}
    if split.get("type") != "Split" or split["behavior"] != "Removed" or not split["invert"] or any(p["type"] != "ByteLevel" or p["add_prefix_space"] or p["use_regex"] for p in pre[1:]):
        return False
    kinds = "aZ7é中²'._-\x00"
    return all(not re.search(r"\s", w) for a in kinds for gap in (" ", "\n", " \n ") for b in kinds for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(f"{a}{a}{gap}{b}{b}"))


class Encoder:
    """Ids of texts, equal to those of the library; as bytes they are little-endian unsigned 32-bit integers.

    If the tokenizer takes what stands between spaces apart from the rest, texts are cut there. Chunks that aren't remembered are normalised and cut into words by the
    tokenizer's own pattern; words that aren't remembered go to the library's model, one by one. Latin chunks are lower-cased here if the library's normaliser does no
    more to them than that, and chunks of letters are words if the pattern takes runs of letters. Chunks with special tokens, white space other than spaces and line
    feeds, or characters past Latin letters, about which two regular expression engines may differ, go to the library as they
    are. With any other tokenizer whole texts do.
    """

    def __init__(self, path: str, remembered: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known, self.words, self.cuts = Recent(remembered), Recent(remembered // 2), cuts_at_spaces(self.tokenizer)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        d = json.loads(self.tokenizer.to_str())
        pres = (d["pre_tokenizer"] or {}).get("pretokenizers", [d["pre_tokenizer"]])
        pre, self.bytewise = pres[0], any(x and x["type"] == "ByteLevel" for x in pres)
        # Words and the spaces between chunks, in one search through many chunks.
        self.word = regex.compile(f"(?:{pre['pattern'].get('Regex') or regex.escape(pre['pattern']['String'])})| ") if self.cuts else None
        self.lowers = bool(self.normalizer) and self.normalizer.normalize_str(LATIN) == LATIN.lower()
        self.runs = self.cuts and bool(RUNS.fullmatch(pre["pattern"].get("Regex", "")))
        self.foreign = re.compile("|".join(["[^\x00-\u024f]", r"[^\S ]", *[re.escape(a["content"]) for a in d["added_tokens"]]]))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_words(self, words: set[str]) -> dict[str, bytes]:
        new = self.words.missing(words)
        known = self.words.young
        spelt = codecs.charmap_decode(" ".join(new).encode(), "strict", BYTES)[0].split(" ") if self.bytewise and new else new
        tokens = self.model.tokenize
        known |= zip(new, [array("I", [t.id for t in tokens(w)]).tobytes() for w in spelt], strict=True)
        return known

    def normal(self, chunks: list[str]) -> list[str]:
        """Latin chunks as the tokenizer normalises them; spaces that this makes are line feeds."""
        if self.lowers:
            return " ".join(chunks).lower().split(" ")
        return [self.normalizer.normalize_str(c).replace(" ", "\n") for c in chunks] if self.normalizer else chunks

    def learn(self, chunks: list[str]) -> None:
        odd = [c for c in chunks if self.foreign.search(c)] if self.foreign.search(" ".join(chunks)) else []
        known = self.known.young
        known |= zip(odd, self.whole(odd), strict=True)
        plain = [c for c in chunks if c not in known] if odd else chunks
        normal = self.normal(plain) if plain else []
        marked = [c for c in normal if not (self.runs and c.isalpha())]
        found = self.word.findall(" ".join(marked))
        words = self.learn_words(set(normal).difference(marked).union(found).difference((" ",)))
        words[" "] = GAP
        ids = b"".join(map(words.__getitem__, found))
        # The gaps tell the chunks apart; no id is that large.
        flat = np.frombuffer(ids, "<u4")
        gaps = np.flatnonzero(flat == 0xFFFFFFFF)
        begin, end = (np.r_[0, gaps + 1] * 4).tolist(), (np.r_[gaps, len(flat)] * 4).tolist()
        cut = dict(zip(marked, [ids[a:b] for a, b in zip(begin, end, strict=True)], strict=True)) if marked else {}
        known |= zip(plain, [cut[c] if c in cut else words[c] for c in normal], strict=True)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        if not self.cuts or not len(texts):
            raw = self.whole(texts.to_pylist()) if len(texts) else []
            return np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw], np.int64)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        chunks = cut.flatten().dictionary_encode()
        kinds, at = chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), chunks.indices.to_numpy()
        new = self.known.missing(set(kinds))
        if new:
            self.learn(new)
        raw = list(map(self.known.young.__getitem__, kinds))
        for c in new:
            if len(c) > 40:
                del self.known.young[c]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        begin, each = np.cumsum(sizes) - sizes, sizes[at]
        upto = np.cumsum(each)
        ids = np.frombuffer(b"".join(raw), "<u4").take(np.repeat(begin[at] - (upto - each), each) + np.arange(int(upto[-1])))
        ends = np.cumsum(pc.list_value_length(cut).to_numpy().astype(np.int64))
        return ids, np.diff(np.r_[0, upto][ends], prepend=0)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int, partitions: int | None = None, row_group: int = 16 << 20) -> None:
    """Writes the ids of all texts, each with end_id after it, in ascending doc_id order (nulls first; equal ids by a hash of the text).

    The texts are range-partitioned once; each task then writes one file of the order. A null text is an empty one. Repeated rows stay. Texts are
    encoded whole, a few MB at a time; a longer one is a batch of its own. doc_ids are numbers (or text of digits, which is cast), as the order is that of numbers.
    """
    d = pick(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    keys = ["doc_id", F.xxhash64("text")]
    d = (d.repartitionByRange(partitions, *keys) if partitions else d.repartitionByRange(*keys)).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        nth = start = 0
        for batch in slices(batches, "text", 2000, 8 << 20):
            found, n = encode(batch.column("text"))
            n = n + 1
            ends = np.cumsum(n)
            flat = np.full(int(ends[-1]), end_id, np.uint32)
            inner = np.ones(len(flat), bool)
            inner[ends - 1] = False
            flat[inner] = found
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat.view(np.int32)))
            cols = [batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(nth, nth + len(n))), pa.array(start + ends - n), pa.array(n), ids]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "nth", "part_start", "n_tokens", "ids"])
            nth, start = nth + len(n), start + int(n.sum())
        release()

    writer = d.mapInArrow(run, SCHEMA).write.mode("overwrite")
    for k, v in {**LAYOUT, "parquet.block.size": str(row_group)}.items():
        writer = writer.option(k, v)
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, most_broadcast: int = 100_000) -> DataFrame:
    """The stored rows with `start`: ids of all documents before. Columns that aren't selected aren't read.

    Starts come from the token counts of whole files: one row for each file, broadcast up to most_broadcast files so that the ids aren't shuffled.
    """
    t = spark.read.schema(SCHEMA).parquet(path)
    totals = t.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", F.coalesce(F.expr("sum(n) over (order by part rows between unbounded preceding and 1 preceding)"), F.lit(0)).alias("base"))
    return t.join(F.broadcast(before) if few(totals, most_broadcast) else before, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def read_documents(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The rows of read_tokens() for doc_ids from first to last. As files follow doc_id, its statistics leave only the row groups, and within them the pages, that overlap this range to be read."""
    return read_tokens(spark, path).where(F.col("doc_id").between(first, last))


def with_checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows from read_tokens()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            ends = np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)) * 4
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)] if len(ends) else []
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "start", "n_tokens")], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

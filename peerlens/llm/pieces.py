"""SentencePiece encoding and decoding that keeps track of the source bytes.

Texts are normalised by the longest prefix in the model's compiled character map, each normalised byte with the source byte
it comes from. Pieces are found by merging, best score first, and projected back to byte spans of the original text. As no
piece of such models reaches from a word into the next space, words are encoded one by one, and what is known of them is remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, pick, release, slices

SPACE = "▁"
#: What a text is cut into: spaces and what follows them; spaces at the end.
CHUNK = re.compile(r" +[^ ]*")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


class CharMap:
    """A compiled character map: a double-array trie of source strings, whose values point into a table of replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.table = blob[4 + size :]
        root = self._offset(self.units[0]) if self.units else 0
        self.first = frozenset(b for b in range(256) if self.units and self._step(root, b) is not None)
        # Whether a source string may hold a space next to something else: a unit for the byte 0x20 that isn't the root's own, or one below that.
        own = root ^ 0x20
        after = own ^ self._offset(self.units[own]) if 0x20 in self.first else 0
        self.spans_spaces = any(u & 0x800000FF == 0x20 and i not in (0, own) for i, u in enumerate(self.units)) or 0x20 in self.first and any(self._step(after, b) is not None for b in range(1, 256))

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        node ^= byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of source[at:] in the map and its replacement."""
        if not self.units or source[at] not in self.first:
            return None
        node, best = self._offset(self.units[0]), None
        for i in range(at, len(source)):
            if (node := self._step(node, source[i])) is None:
                break
            unit = self.units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        return best and (best[0], self.table[best[1] : self.table.index(b"\0", best[1])])


class Normalizer:
    def __init__(self, spec) -> None:
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def keeps(self, text: str) -> bool:
        """Whether a text without spaces stays as it is: it has no byte that the map's source strings begin with."""
        return not self.map.first or self.map.first.isdisjoint(text.encode())

    def __call__(self, text: str, inside: bool = False) -> tuple[bytes, list[int]]:
        """Normalised UTF-8 and, for each of its bytes and its end, the source byte that it comes from.

        inside: the text is what follows a space inside of a longer one; that space is put first, and nothing is taken off.
        """
        source, out, align = text.encode(), bytearray(), []
        space = SPACE.encode() if self.escape else b" "
        at, size = 0, len(source)

        def prefix() -> tuple[int, bytes]:
            """Source bytes taken and what they become; a character that the map doesn't hold stays, byte for byte."""
            if found := self.map.longest(source, at):
                return found
            b = source[at]
            n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            return n, source[at : at + n]

        if self.squeeze and not inside:
            while at < size and (p := prefix())[1] == b" ":
                at += p[0]
        if at == size and not inside:
            return b"", [at]
        if self.dummy or inside:
            out += space
            align += [at - inside] * len(space)
        after_space = self.squeeze and not inside
        while at < size:
            n, made = prefix()
            while after_space and made.startswith(b" "):
                made = made[1:]
            if made:
                same = made == source[at : at + n]
                for k, b in enumerate(made):
                    piece = space if b == 0x20 else bytes([b])
                    out += piece
                    align += [at + k * same] * len(piece)
                after_space = made.endswith(b" ")
            at += n
            after_space = after_space and self.squeeze
        if self.squeeze and not inside:
            while out.endswith(space):
                del out[-len(space) :]
                at = align[-len(space)]
                del align[-len(space) :]
        return bytes(out), [*align, at]


class Merges:
    """All ways to join two neighbouring symbols into a piece. A symbol is a piece, or a character that is none (its code point from CHARACTERS on)."""

    CHARACTERS, NONE = 1 << 28, np.int32(2**31 - 1)

    def __init__(self, scores: dict[str, float], ids: dict[str, int]):
        self.rank_of = {x: i for i, x in enumerate(sorted(set(scores.values()), reverse=True))}
        symbol = lambda x: ids.get(x, self.CHARACTERS + ord(x) if len(x) == 1 else None)
        splits = ((symbol(p[:k]), symbol(p[k:]), ids[p], self.rank_of[x]) for p, x in scores.items() for k in range(1, len(p)))
        rows = np.array([r for r in splits if r[0] is not None and r[1] is not None], np.int64).reshape(-1, 4)
        keys = (rows[:, 0] << 32) + rows[:, 1]
        order = np.argsort(keys)
        self.keys = np.r_[keys[order], np.iinfo(np.int64).max]
        self.made, self.ranks = np.r_[rows[order, 2], -1], np.r_[rows[order, 3], self.NONE].astype(np.int32)
        self.code = np.arange(0x110000, dtype=np.int64) + self.CHARACTERS
        for p, i in ids.items():
            if len(p) == 1:
                self.code[ord(p)] = i

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the arrays; the last one for pairs that don't join."""
        keys = (left << 32) + right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, at, len(self.keys) - 1)

    def __call__(self, words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words of at most `width` characters, one after the other, and how many each word has.

        Step by step, every word joins its best pair, the leftmost of equals, until it has none.
        """
        sizes = np.array([len(w) for w in words])
        m = np.full((len(words), width), -1, np.int64)
        m[np.arange(width) < sizes[:, None]] = self.code[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        out, rows, column = np.full_like(m, -1), np.arange(len(m)), np.arange(width)
        ranks = self.ranks[self.find(m[:, :-1], m[:, 1:])]
        while len(rows):
            j = ranks.argmin(axis=1)
            live = ranks[np.arange(len(j)), j] < self.NONE
            if not live.all():
                out[rows[~live]] = m[~live]
                rows, m, ranks, j = rows[live], m[live], ranks[live], j[live]
            at, before = np.arange(len(j)), np.flatnonzero(j)
            new = self.made[self.find(m[at, j], m[at, j + 1])]
            m = np.take_along_axis(m, np.minimum(column + (column > j[:, None]), width - 1), 1)
            ranks = np.take_along_axis(ranks, np.minimum(column[:-1] + (column[:-1] >= j[:, None]), width - 2), 1)
            m[:, -1], ranks[:, -1], m[at, j] = -1, self.NONE, new
            ranks[at, j] = self.ranks[self.find(new, m[at, j + 1])]
            ranks[before, j[before] - 1] = self.ranks[self.find(m[before, j[before] - 1], new[before])]
        return out[out >= 0], (out >= 0).sum(axis=1)


class Coder:
    """A BPE model with byte fallback and no user-defined or unused pieces."""

    #: Words are merged together in groups of so many characters at most; longer ones one by one.
    WIDTHS = (6, 8, 10, 12, 16, 24, 64)

    def __init__(self, path: str, remembered: int = 80_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        kinds = {p.type for p in m.pieces}
        if m.trainer_spec.model_type != BPE or not m.trainer_spec.byte_fallback or kinds & {USER, UNUSED} or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, without user-defined or unused pieces, are supported")
        self.pieces = [p.piece for p in m.pieces]
        self.scores = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i, p in enumerate(m.pieces) if p.type == CONTROL}
        self.unknown, self.unknown_text = m.trainer_spec.unk_id, m.trainer_spec.unk_surface
        self.begin, self.end = m.trainer_spec.bos_id, m.trainer_spec.eos_id
        self.normalizer = Normalizer(m.normalizer_spec)
        inner = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.scores)
        lone = "" if any("\n" in p for p in self.scores) else "\n"
        self.cut = re.compile(r"(?s).+" if inner else rf"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + (r"|\n+" if lone else ""))
        self.parts = re.compile(f"[ {SPACE}{lone}]")
        self.merges = Merges(self.scores, self.ids)
        self.sizes = np.array([len(p.encode()) for p in self.pieces], np.uint8)  # more than 255 bytes raise an error
        # What is known: of normalised words their ids, bytes of each piece and decoded text; of chunks (what follows a space up to the next run of spaces)
        # their ids, source bytes of each piece (the space's with the first), and decoded text.
        self.words, self.chunks = Recent(remembered // 4), Recent(remembered)
        # A text may be cut before each run of spaces if no piece reaches over such a place and the character map neither.
        self.by_chunk = self.normalizer.dummy and self.normalizer.escape and not inner and not self.normalizer.map.spans_spaces

    def merge(self, word: str) -> list[int]:
        """ids of a word: neighbours are merged, best score first, leftmost first among equals; unknown characters become bytes."""
        s = list(word)
        n = len(s)
        left, right, heap = list(range(-1, n - 1)), list(range(1, n + 1)), []
        scores = self.scores

        def offer(i: int, j: int) -> None:
            piece = s[i] + s[j]
            if (x := scores.get(piece)) is not None:
                heapq.heappush(heap, (-x, i, j, piece))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, piece = heapq.heappop(heap)
            if not s[i] or not s[j] or len(s[i]) + len(s[j]) != len(piece):
                continue
            s[i], s[j] = piece, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        return [i for x in s if x for i in ([self.ids[x]] if x in self.ids else [self.byte_ids[b] for b in x.encode()])]

    def decode_pieces(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                raw.append(self.bytes_of[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw = bytearray()
            if i not in self.silent:
                out.append(self.unknown_text if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        return "".join(out) + raw.decode(errors="replace")

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; the space that encoding puts first is taken off."""
        text = self.decode_pieces(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if self.normalizer.dummy and first is not None and first not in self.bytes_of and text.startswith(" ") else text

    def learn(self, words: set[str]) -> dict[str, tuple[bytes, bytes, str]]:
        """What is known of normalised words, these among them."""
        new = self.words.missing(words)
        known = self.words.young
        for w, ids, sizes in self.merged(new):
            known[w] = self.alone(w) if ids is None else (ids, sizes, w.replace(SPACE, " "))
        return known

    def merged(self, words: list[str] | set[str], together: int = 20_000) -> Iterator[tuple[str, bytes | None, bytes]]:
        """Each word with its ids and bytes of each piece; many short ones are merged at a time. Without them where the word is long or has characters that are no pieces."""
        new = sorted(words, key=len)
        lengths = np.array([len(w) for w in new])
        for low, high in zip((0, *self.WIDTHS), self.WIDTHS):
            first, last = np.searchsorted(lengths, [low, high], side="right").tolist()
            for at in range(first, last, together):
                part = new[at : min(at + together, last)]
                symbols, n = self.merges(part, high)
                ends = np.cumsum(n)
                bad = np.zeros(len(part), bool)
                bad[np.repeat(np.arange(len(part)), n)[symbols >= Merges.CHARACTERS]] = True
                raw, sizes = symbols.astype("<u4").tobytes(), self.sizes[np.minimum(symbols, len(self.sizes) - 1)].tobytes()
                for w, a, b, x in zip(part, (ends - n).tolist(), ends.tolist(), bad.tolist(), strict=True):
                    yield w, None if x else raw[4 * a : 4 * b], sizes[a:b]
        for w in new[int(np.searchsorted(lengths, self.WIDTHS[-1], side="right")) :]:
            yield w, None, b""

    def alone(self, word: str) -> tuple[bytes, bytes, str]:
        ids = self.merge(word)
        return array("I", ids).tobytes(), bytes([1 if i in self.bytes_of else self.sizes[i] for i in ids]), self.decode_pieces(ids)

    def learn_chunks(self, chunks: list[str]) -> None:
        """Takes chunks in, each normalised. None for one that can't be encoded apart from its neighbours, because spaces come of its other characters or nothing does.

        A chunk that the normaliser keeps as it is, and that is one word, has its pieces' own bytes; with the first one goes a byte for the space.
        """
        apart, extra, known_chunks = self.parts, len(SPACE.encode()) - 1, self.chunks.young
        whole = {SPACE + c for c in chunks if c and not apart.search(c) and self.normalizer.keeps(c)}
        for w, ids, sizes in self.merged(whole):
            c = w[1:]
            if ids is not None and len(c) < 250:
                known_chunks[c] = ids, bytes((sizes[0] - extra,)) + sizes[1:], c
        made = []
        for c in [c for c in chunks if c not in known_chunks]:
            raw, align = self.normalizer(c, True)
            known = raw.decode()
            body = known[1:]
            unsafe = c.strip(" ") and (not body or body.endswith(SPACE) or self.normalizer.squeeze and body.startswith(SPACE))
            made.append((c, None if unsafe else self.cut.findall(known), align))
        of = self.learn({w for _, words, _ in made if words for w in words})
        for c, words, align in made:
            known_chunks[c] = words and self.chunk(c, [of[w] for w in words], align)

    @staticmethod
    def chunk(c: str, parts: list[tuple[bytes, bytes, str]], align: list[int]) -> tuple[bytes, bytes, str] | None:
        at, before, out = 0, -1, []
        for p in parts:
            for n in p[1]:
                at += n
                out.append(align[at] - before)
                before = align[at]
        text = "".join([p[2] for p in parts])[1:]
        return None if max(out) > 255 else (b"".join([p[0] for p in parts]), bytes(out), c if text == c else text)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
        """For each text its ids without begin and end, the source byte at which each piece ends, and the decoded text.

        The first piece starts at byte 0 and each other one where the one before ends; a piece that stands for a single byte covers just that.
        Chunks and words are normalised and merged once for all texts of the call, and for later ones as far as they are remembered.
        """
        cut = [self.chunks_of(t) for t in texts]
        new = self.chunks.missing(set().union(*[c for c in cut if c]))
        self.learn_chunks(new)
        known = self.chunks.young
        for t, c in zip(texts, cut, strict=True):
            parts = c and [known[x] for x in c]
            if not parts or None in parts:
                yield self.encode_aligned(t)
                continue
            ids = np.frombuffer(b"".join([p[0] for p in parts]), "<u4")
            ends = np.cumsum(np.frombuffer(b"".join([p[1] for p in parts]), np.uint8), dtype=np.int64) - 1
            yield ids, ends, " ".join([p[2] for p in parts])
        for c in new:
            if len(c) > 40:
                del known[c]

    def chunks_of(self, text: str) -> list[str] | None:
        if not text or not self.by_chunk:
            return None
        if "  " in text or text[0] == " " or text[-1] == " ":
            return None if self.normalizer.squeeze else [c[1:] for c in CHUNK.findall(" " + text)]
        return text.split(" ")

    def encode_aligned(self, text: str) -> tuple[np.ndarray, np.ndarray, str]:
        """As encode(), with the whole text normalised at once."""
        raw, align = self.normalizer(text)
        words = self.cut.findall(raw.decode())
        parts = list(map(self.learn(set(words)).__getitem__, words))
        ids = np.frombuffer(b"".join([p[0] for p in parts]), "<u4")
        ends = np.array(align)[np.cumsum(np.frombuffer(b"".join([p[1] for p in parts]), np.uint8), dtype=np.int64)]
        decoded = "".join([p[2] for p in parts])
        return ids, ends, decoded[1:] if self.normalizer.dummy and decoded.startswith(" ") else decoded


@lru_cache(maxsize=4)
def coder(path: str, remembered: int = 80_000) -> Coder:
    return Coder(path, remembered)


def encode_documents(docs: DataFrame, model: str, outputs: tuple[str, ...] = ("ids", "ends", "decoded"), keep: tuple[str, ...] = (), remembered: int = 80_000) -> DataFrame:
    """Encodes every row's whole text with begin and end ids, and decodes it again.

    Returns doc_id, n_tokens (all ids) and those asked for of: ids (array<int>), ends (array<int>: source byte where each piece ends, begin and
    end ids without), decoded, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 (UTF-8), ends_crc32 (as unsigned 64-bit integers);
    then the columns `keep`. A null text is an empty one and gets the begin and end ids only. Repeated rows stay; further columns are ignored. Texts
    are encoded whole, about 4 MB at a time; a longer one is a batch of its own. A worker remembers so many chunks at least, and up
    to twice as many: some 300 bytes each.
    """
    kinds = {"ids": "array<int>", "ends": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string", "ends_crc32": "bigint"}

    types = {"array<int>": pa.list_(pa.int32()), "string": pa.string(), "bigint": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model, remembered)
        head, tail = np.array([c.begin], "<u4").tobytes(), np.array([c.end], "<u4").tobytes()
        for batch in slices(batches, "text"):
            out = {"n_tokens": [], **{k: [] for k in outputs}}
            for ids, ends, decoded in c.encode(batch.column("text").to_pylist()):
                raw = head + ids.tobytes() + tail
                out["n_tokens"].append(len(ids) + 2)
                for k in outputs:
                    out[k].append(
                        np.frombuffer(raw, "<i4") if k == "ids" else ends.astype(np.int32) if k == "ends" else decoded if k == "decoded"
                        else hashlib.sha256(raw).hexdigest() if k == "ids_sha256" else hashlib.sha256(decoded.encode()).hexdigest() if k == "decoded_sha256"
                        else zlib.crc32(ends.astype("<u8").tobytes())
                    )
            arrays = [pa.array(out["n_tokens"], pa.int64()), *[pa.array(out[k], types[kinds[k]]) for k in outputs]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays, *[batch.column(x) for x in keep]], ["doc_id", "n_tokens", *outputs, *keep])
        c.chunks.rest()
        c.words.rest()
        release()

    d = pick(docs, doc_id="", text="string", **dict.fromkeys(keep, "")).withColumn("text", F.coalesce("text", F.lit("")))
    schema = ", ".join([f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens bigint", *[f"{k} {kinds[k]}" for k in outputs], *[f"`{x}` {d.schema[x].dataType.simpleString()}" for x in keep]])
    return d.mapInArrow(run, schema)

"""Chunks and words of the token store's encoder against whole encodings by the library."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path as tokenizer_path
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

from peerlens.llm import token_store

PATH = tokenizer_path("word_bpe_49k.json")


def check(encoder: token_store.Encoder, *batches: list[str]) -> None:
    for texts in batches:
        ids, n = encoder(pa.array(texts, pa.string()))
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize(
    "texts",
    [
        ["漢字", "仮名 漢字"],  # nothing but foreign chunks
        ["x \t a\tb y"],  # one chunk is nothing but white space, another one holds some
        ["a\x85b c\xa0d \xa0 e\x0bf\x1cg"],
        ["", " ", "\n\n", "  a  b "],
        ["İstanbul ÀÉÎ ß ſ Ǆ ǅ ǆ 'sea d'll 's 're'VE it's I'M", "¨ ¯ ´ ½ ² ª µ Å Å Σας"],
        ["<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "abc123def4.5,,x--y_z don't"],
    ],
)
def test_chunks_are_encoded_as_the_library_does(texts):
    check(token_store.Encoder(PATH), texts, texts[::-1])


def test_latin_characters_alone_and_within_words():
    e = token_store.Encoder(PATH)
    assert e.cuts and e.lowers and e.runs and e.bytewise
    check(e, [chr(i) for i in range(0x260)], [f"Ab{chr(i)}cD {chr(i)}{chr(i)} {chr(i)}, 1{chr(i)}" for i in range(0x260)])


def test_words_go_to_the_model_alone(monkeypatch):
    """The library's normaliser and encoder, which cost most of the query's time, aren't asked about Latin texts."""
    e, texts = token_store.Encoder(PATH), ["The naïve Ærø, über-groß isn't 42 ***", "the (Naïve) tokens."]
    want = [i for x in e.tokenizer.encode_batch(texts, add_special_tokens=False) for i in x.ids]
    monkeypatch.setattr(token_store.Encoder, "whole", lambda self, texts: [1 / 0 for _ in texts])
    e.normalizer = e.tokenizer = None
    assert e(pa.array(texts))[0].tolist() == want


def test_bytes_are_spelt_as_the_library_does():
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    for text in ["".join(map(chr, range(0x21))).replace(" ", ""), "".join(map(chr, range(0x21, 0x800))), "漢字😀\U000fffff"]:
        assert "".join(token_store.BYTES[b] for b in text.encode()) == level.pre_tokenize_str(text)[0][0]


@pytest.mark.parametrize(
    ("pattern", "runs"),
    [
        (r"'s|'ll|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", True),
        (r"\p{L}+|[^\s\p{L}]", True),
        (r"'?s|\p{L}+|[^\s\p{L}]", False),  # an s at the start is a word of its own
        (r"s|\p{L}+|[^\s\p{L}]", False),
        (r"\p{L}{1,3}|[^\s\p{L}]", False),
        (r"\p{Lu}?\p{Ll}+|[^\s]", False),
    ],
)
@pytest.mark.parametrize("norm", [None, "NFKC", "NFD"])
def test_other_patterns_and_normalisers(tmp_path, pattern, runs, norm):
    t = Tokenizer.from_file(PATH)
    t.normalizer = normalizers.Sequence([getattr(normalizers, norm)()] if norm else [])
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    t.save(at := str(tmp_path / "t.json"))
    e = token_store.Encoder(at)
    assert e.cuts and e.runs == runs and not e.lowers
    check(e, ["Sea seasons's ¨ x  ´a Ǆ ½ CamelCase, it'll"], ["éÉ\tZ seas ss", "漢字"])


def test_most_of_a_long_batch_is_known_from_before():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeéßÑ.,'7"), rng.integers(1, 9))) for _ in range(3000)]
    e = token_store.Encoder(PATH, 500)
    check(e, *[[" ".join(rng.choice(words, 40)) for _ in range(60)] for _ in range(4)])

"""Encoding with a model whose character map isn't empty: ids and source spans against the library's."""

from __future__ import annotations

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from peerlens.llm import pieces
from peerlens.llm.queries import tokenizer_path

TEXTS = [
    "ﬁne Ａ①½ Ⅷ words", "é café 가각 ｶﾞ", "plain words only", "　x y  z", "​z zero", "", " lead and trail ", "ㅎㅏㄴ 한 ﷺ", "a ﬃ b" * 40, "ＦＵＬＬ width, then ﬂat and plain words, words, words",
    "tab\there\nline ², ³ and ™", "…‥ ℃ №", "naïve café \U0001f600 Å",
]


@pytest.fixture(scope="module", params=["nmt_nfkc", "nfkc_cf"])
def model(request, tmp_path_factory):
    m = pb.ModelProto()
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        m.ParseFromString(f.read())
    own = pb.ModelProto()
    own.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=request.param).serialized_model_proto())
    m.normalizer_spec.precompiled_charsmap = own.normalizer_spec.precompiled_charsmap
    m.normalizer_spec.name = request.param
    path = tmp_path_factory.mktemp("model") / "mapped.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_ids_and_spans_through_a_real_character_map(model):
    lib, own = sentencepiece.SentencePieceProcessor(model_file=model), pieces.Coder(model)
    for t, (ids, ends, decoded) in zip(TEXTS, own.encode(TEXTS), strict=True):
        want = lib.encode(t, return_type="proto")
        assert ids.tolist() == [p.id for p in want.pieces], t
        assert ends.tolist() == [p.end for p in want.pieces] and decoded == lib.decode(ids.tolist()), t
        raw = t.encode()
        spans = [raw[a:b] for a, b in zip([0, *ends.tolist()[:-1]], ends.tolist(), strict=True)] if len(ends) else []
        assert [s.decode() for s in spans] == [p.surface for p in want.pieces]


def test_the_normaliser_is_what_encodes(model):
    """A text that the map changes gets the ids of what the map makes of it; one that it leaves alone skips nothing it needs."""
    own = pieces.Coder(model)
    (a, b, c), plain = [ids.tolist() for ids, _, _ in own.encode(["ﬁne", "fine", "ｆｉｎｅ"])], pieces.Coder(tokenizer_path("piece_bpe_32k.model"))
    assert a == b == c and next(plain.encode(["ﬁne"]))[0].tolist() != a

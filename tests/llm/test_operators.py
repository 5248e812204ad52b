from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlens.llm import decontaminate, langid, pieces, quality, sharding, token_store, url_filter
from peerlens.llm.common import workspace
from peerlens.llm.queries import tokenizer_path

LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(30_000))
TEXTS = ["The quick brown fox jumps over the lazy dog and then it sleeps", None, "", " \n\t ", "ÀÉ ßtraße ﬁ Ａ 中文 あ😀 \x00", "a  b\n\n c ", "don't WE'LL 12 3²", LONG, "short", "short"]
#: Further columns whose names clash with wanted or inner ones.
EXTRA = "doc_id bigint, text string, Text string, words int, pos int"


def frame(spark, texts=TEXTS, ids=None):
    ids = ids if ids is not None else list(range(len(texts)))
    return spark.createDataFrame([(i, t, "no", 1, 2) for i, t in zip(ids, texts, strict=True)], EXTRA).repartition(3)


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def hits(text, items, width=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        for win in {tuple(x[i : i + width]) for i in range(max(1, len(x) - width + 1))} if x else ():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_decontamination(spark, broadcast):
    base = [f"t{i}" for i in range(40)]
    items = [(10, " ".join(base[:15])), (9, " ".join(base[3:14])), (100, "Two words"), (7, "single"), (8, None), (6, "..."), (10, " ".join(base[:15]))]
    texts = [" ".join(base), " ".join(base[:10]), " ".join(base[:9]), "two, WORDS two words", "a single one", None, "", " ".join(base[:15] * 3), " ".join(base[20:]), "single"]
    ids = [*range(8), 8, None]
    b = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id bigint, text string, h int")
    got = decontaminate.decontaminate(spark, frame(spark, texts, ids), b, most_broadcast=broadcast).collect()
    want = {i: hits(t, items) for i, t in zip(ids, texts, strict=True)}
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in got} == want and len(got) == len(ids)
    assert all(r.contaminated == (r.n_hit > 0) for r in got)
    again = decontaminate.decontaminate(spark, frame(spark, ["single"] * 3, [1, 1, 1]), b, most_broadcast=broadcast).collect()
    assert [(r.doc_id, r.n_hit) for r in again] == [(1, 1)] * 3
    assert decontaminate.decontaminate(spark, frame(spark, [], []), b).count() == 0
    assert decontaminate.decontaminate(spark, frame(spark), b.limit(0)).where("contaminated").count() == 0


def base_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(grams)
    rep = {j for i, g in enumerate(grams) if c[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), len(lines) - len(set(lines)), len(rep)


def test_quality_ledger(spark):
    texts = [*TEXTS, "a b c d e f g a b c d e f x", "a a a a a a", "x\nx\n x\n\n\nx", "#|<> &" * 50, "you idiot are a fine clown in this text of ten words", "ok " * 3]
    led = quality.ledger(frame(spark, texts), ["idiot", "clown"])
    got = {r.doc_id: r for r in quality.apply_policy(led, quality.POLICIES["clean", 3]).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_measures(t)
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert bool(r.failures & quality.POLICIES["base", 1].mask) == failed and (not failed or not r.kept)
    assert got[0].kept and not got[14].kept
    a = {r.rule: r for r in quality.ablations(led, quality.POLICIES["clean", 3]).collect()}
    assert a["toxic"].n_failed == 1 and a["toxic"].n_only == 1
    assert all(r.n_docs == len(texts) for r in a.values())
    assert quality.ledger(frame(spark, [], [])).count() == 0


def test_sharding(spark):
    ids = [*range(200), 7, 7, 7, None, None]
    texts = ["é" * (i or 0) if i != 3 else None for i in ids]
    got = sharding.shard_documents(frame(spark, texts, ids), 8, rows_a_bucket=16).collect()
    assert len(got) == len(ids)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got) and {r.shard for r in got} == set(range(8))
    by = {r.doc_id: r for r in got}
    assert by[10].size == 21 and by[3].size == 1 and by[10].text_crc32 == zlib.crc32(("é" * 10).encode())
    assert sharding.shard_documents(frame(spark, [], [])).count() == 0
    keys = np.arange(5000) * 2654435761
    assert (sharding.jump_hash(keys, 1) == 0).all()
    for n in (2, 9, 100):
        a, b = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert ((a == b) | (b == n)).all() and abs((b == n).mean() - 1 / (n + 1)) < 0.03


def jump(key, shards):
    """The published algorithm, one key at a time."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding_against_one_key_at_a_time(spark):
    import xxhash

    ids = [*range(-20, 300), (1 << 63) - 1, -(1 << 63), None, 5, 5]
    texts = [f"text {i}" if i != 7 else None for i in ids]
    got = sharding.shard_documents(frame(spark, texts, ids), 8, rows_a_bucket=50).collect()
    of = lambda i: xxhash.xxh64(str(i) if i is not None else "", seed=42).intdigest()
    assert all(r.shard == jump(of(r.doc_id), 8) and r.grown_shard == jump(of(r.doc_id), 9) for r in got)
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True)), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == want
    assert len({(r.shard, r.slot) for r in got}) == len(ids) and max(r.slot for r in got) < len(ids)


def test_language_id_against_plain_cosines(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the other thing were there", "en"), ("der Hund und die Katze sind nicht hier", "de"), ("le chat et les chiens ne sont pas", "fr")] * 2)]
    train, texts = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), ["another thing", "die andere", "dans le chat", "xyz", "!", LONG[:5000]]
    enc = langid.Encoder(256)

    def vector(t):
        c = langid.codes(t).tolist()
        grams = [(a << 42) | (b << 21) | d for a, b, d in zip(c, c[1:], c[2:], strict=False) if b]
        return np.sum([enc.vectors(np.array([g]))[0].astype(float) for g in grams], axis=0) if grams else np.zeros(256)

    proto = {lang: np.sum([vector(t) for _, t, x in rows if x == lang], axis=0) for lang in ("de", "en", "fr")}
    got = {r.doc_id: r for r in langid.predict(frame(spark, texts), langid.train(train, dim=256), dim=256).collect()}
    for i, t in enumerate(texts):
        v = vector(t)
        cos = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) if v.any() else 0.0 for k, p in proto.items()}
        best = max(sorted(cos), key=lambda k: cos[k])
        assert (got[i].lang_pred, got[i].score) == ((best, pytest.approx(max(cos[best], 0), abs=1e-5)) if v.any() else ("und", 0))
    tie = spark.createDataFrame([(0, "same words", "b"), (1, "same words", "a")], "doc_id bigint, text string, lang string")
    assert langid.predict(frame(spark, ["same words"], [1]), langid.train(tie)).first().lang_pred == "a"


def test_language_id_on_held_out_documents(spark):
    from peerlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and length(text) > 40").select("doc_id", "lang")
    r = QUERIES["op6_language_id"](spark, sf).where("held_out").join(known, "doc_id").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert r.n > 200 and r.right > 0.95


def test_language_id(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the other thing were there with them", "en"), ("der Hund und die Katze sind nicht hier gewesen", "de"), ("le chat et les chiens ne sont pas dans la maison", "fr")] * 3)]
    d = spark.createDataFrame([*rows, (90, None, "en"), (91, "12 !!", "en"), (92, "x", None)], "doc_id bigint, text string, lang string")
    p = langid.train(d, dim=512)
    test = frame(spark, ["this is another cat with the thing", "die Katze und der andere Hund", "les maisons ne sont pas dans le chat", None, "", "123 ...", LONG])
    got = {r.doc_id: r for r in langid.predict(test, p, dim=512).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["en", "de", "fr", "und", "und", "und"] and all(0 <= r.score <= 1 for r in got.values())
    none = langid.predict(test, p.limit(0), dim=512).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == 7


def test_language_vectors_are_bundles_of_bound_letters():
    enc = langid.Encoder(64)
    got = langid.bundles(enc, ["ab c"], [0], 1)[0]
    v = lambda s: np.roll(enc.letter(ord(s[0]) if s[0] != " " else 0), 2) * np.roll(enc.letter(ord(s[1])), 1) * enc.letter(ord(s[2]) if s[2] != " " else 0)
    assert (got == v(" ab") + v("ab ") + v(" c ")).all()
    small = langid.bundles(langid.Encoder(64), ["ab c", "zz top"], [0, 1], 2, most=2)
    assert (small == langid.bundles(langid.Encoder(64), ["ab c", "zz top"], [0, 1], 2)).all()


def test_sentencepiece(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*TEXTS, "▁ x▁y", " lead", "trail ", "<s> </s> <0x0A>", "two  spaces"]
    got = {r.doc_id: r for r in pieces.encode_documents(frame(spark, texts), path, ("ids", "ends", "decoded", "ids_sha256", "decoded_sha256")).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].ids == ids and got[i].decoded == sp.decode(ids) and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].ends == sorted(got[i].ends) and (not t or got[i].ends[-1] == len(t.encode()))
    c = pieces.Coder(path)
    met, normal = [], c.normalizer

    class Spy(pieces.Normalizer):
        def __init__(self):
            self.__dict__ = normal.__dict__

        def keeps(self, text):
            met.append(text)
            return False

    c.normalizer = Spy()
    list(c.encode(["some words here and words there"]))
    assert sorted(met) == ["and", "here", "some", "there", "words"] and c.by_chunk  # each distinct chunk goes through the normaliser, once
    c = pieces.coder(path)
    raw = "naïve café".encode()
    ids, ends, _ = next(c.encode(["naïve café"]))
    spans = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    assert b"".join(spans) == raw and c.decode(ids.tolist()) == "naïve café"
    assert pieces.encode_documents(frame(spark, [], []), path).count() == 0


def test_normaliser_against_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    for rule in ("nmt_nfkc", "nfkc_cf"):
        lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        m = pb.ModelProto()
        m.ParseFromString(lib.serialized_model_proto())
        own = pieces.Normalizer(m.normalizer_spec)
        for t in ["ﬁne Ａ①½ Ⅷ", "e\u0301 가각 ｶﾞ", "plain", "　x\u00a0y", "\u200bz"]:
            raw, align = own(t)
            assert raw.decode() == lib.normalize(t)
            assert len(align) == len(raw) + 1 and align == sorted(align) and align[-1] == len(t.encode())


def test_token_store(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts, ids = [*TEXTS, "<|endoftext|> İı", "x y z"], [5, 3, 9, 1, 0, 2, 8, 7, 7, 4, 6, None]
    at = f"{workspace(spark)}/tokens"
    token_store.write_tokens(frame(spark, texts, ids), path, at, end_id=1, partitions=3)
    t = token_store.read_tokens(spark, at)
    start, want = 0, []
    got = sorted(token_store.with_checksums(t).collect(), key=lambda r: r.start)
    for r in got:
        assert r.start == start
        start += r.n_tokens
    for i, x in zip(ids, texts, strict=True):
        e = np.array([*tok.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, len(e), zlib.crc32(e.tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    order = [r.doc_id for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    import glob

    import pyarrow.parquet as pq

    meta = pq.ParquetFile(next(f for f in glob.glob(at.removeprefix("file://") + "/part-*.parquet") if pq.ParquetFile(f).metadata.num_rows)).metadata.row_group(0)
    cols = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    tokens = next(v for k, v in cols.items() if k.startswith("ids"))
    assert any("DICTIONARY" in e or "DELTA" in e for e in tokens.encodings) and tokens.has_offset_index and "DELTA_BINARY_PACKED" in cols["n_tokens"].encodings
    empty = f"{workspace(spark)}/empty"
    assert token_store.read_documents(spark, at, 2, 4).select("doc_id").distinct().count() == 3
    token_store.write_tokens(frame(spark, [], []), path, empty, end_id=1)
    assert token_store.read_tokens(spark, empty).count() == 0


def test_token_store_reads_row_groups_of_a_range(spark):
    import glob

    import pyarrow.parquet as pq

    path, at = tokenizer_path("word_bpe_49k.json"), f"{workspace(spark)}/tokens"
    texts = [" ".join(f"word{i * 31 % 997} {k}" for k in range(40)) for i in range(3000)]
    token_store.write_tokens(frame(spark, texts), path, at, end_id=1, partitions=2, row_group=64 << 10)
    groups = [g for f in glob.glob(at.removeprefix("file://") + "/part-*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert len(groups) > 6 and sum(g.num_rows for g in groups) == 3000
    spans = sorted((g.column(0).statistics.min, g.column(0).statistics.max) for g in groups)
    assert all(a[1] < b[0] for a, b in zip(spans[:-1], spans[1:], strict=True)) and sum(low <= 110 and high >= 100 for low, high in spans) <= 2
    some = token_store.read_documents(spark, at, 100, 110)
    assert sorted(r.doc_id for r in some.collect()) == list(range(100, 111))
    assert "GreaterThanOrEqual(doc_id,100)" in some._jdf.queryExecution().explainString(some.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_url_filter(spark):
    urls = [
        "http://a.com/x", "http://a.com", "https://WWW.Example.com/en/1?q", "https://m.www.example.com/en/", "http://x.example.com/en/9#f", "http://example.com/enx", "ftp://b.net/es/", "http://b.net/ES/", "b.net/es/",
        None, "", "http://notexample.com/en/1", "http://com/", "http://com:80/", "x://y://b.net/fr/", "http://b.net/fr/" + "z" * 50_000, "http://a.com/x",
    ]
    rules = spark.createDataFrame([*url_filter.RULES, (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    p = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")

    def brute(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + q), h + q, v) for h, q, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")

    for small in (10, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(p, rules, most_broadcast=small).collect()}
        assert got == {i: brute(u) for i, u in enumerate(urls)}
    long = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "example.com/en/x")], "page_id bigint, url string")
    assert [r.rule for r in url_filter.judge_urls(long, rules).collect()] == ["example.com/en/"]
    twice = p.where("page_id < 3").withColumn("page_id", F.lit(None).cast("bigint"))
    assert url_filter.judge_urls(twice.union(twice), rules).count() == 6
    assert url_filter.judge_urls(p, rules.limit(0)).where("verdict = 'block'").count() == 0
    assert url_filter.judge_urls(p.limit(0), rules).count() == 0

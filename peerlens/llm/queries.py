"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontaminate, langid, license_scan, line_dedup, lm_score, near_dup, pieces, quality, sharding, token_store, url_filter, whitening
from .common import workspace
from .oracles import ORACLE as ORACLE


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate.decontaminate(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(spark, _read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(spark, _read(spark, sf_dir, "documents"), langid.fold(F.col("doc_id"), 7) == 2, order=3)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    led = quality.ledger(docs, quality.learn_lexicon(docs, _read(spark, sf_dir, "labels")))
    led = quality.apply_policy(led, quality.POLICIES["clean", 3])
    base = F.col("failures").bitwiseAND(F.lit(quality.POLICIES["base", 1].mask)) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failures", "n_bangs", "n_upper", "n_lines", "n_plain", "n_toxic")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy does alone and together with the others; reads the ledger's masks."""
    docs = _read(spark, sf_dir, "documents")
    return quality.ablations(quality.ledger(docs, quality.learn_lexicon(docs, _read(spark, sf_dir, "labels"))), quality.POLICIES["clean", 3])


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"), 8)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").withColumn("held_out", langid.fold(F.col("doc_id"), 3) == 1)
    prototypes = langid.train(d.where("not held_out"))
    return langid.predict(d, prototypes, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), ("ids_sha256", "decoded_sha256", "ends_crc32"), remembered=400_000)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{workspace(spark)}/tokens"
    token_store.write_tokens(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), path, end_id=1)
    return token_store.with_checksums(token_store.read_tokens(spark, path))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), rules)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(spark, _read(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan_licenses(_read(spark, sf_dir, "documents")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(spark, _read(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_embeddings(spark, _read(spark, sf_dir, "embeddings"))


_ALL = (
    op1_decontaminate, op2_line_dedup, op3_lm_score, op4_quality_rules, op5_sharding, op6_language_id, op7_sentencepiece, op8_token_store, op9_url_filter, op10_minhash,
    op11_license_scan, op12_whitening, op13_centroids, quality_ablations,
)
QUERIES = {f.__name__: f for f in _ALL}

"""The corpus pipeline: quality rules, line dedup, near dedup, decontamination, tokens.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents, whatever further columns those have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm import decontaminate, line_dedup, near_dup, pieces, quality
from peerlens.llm.common import few, pick, tagged, untagged, workspace, written
from peerlens.llm.queries import tokenizer_path

#: Ids of dropped documents are sent to every executor up to so many; beyond, Spark shuffles.
MOST_BROADCAST = 2_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for the rows with these doc_ids; a null id matches a null one."""
    rows = tagged(docs, "doc_id")
    gone = ids.select(F.col("doc_id").alias("gone"))
    kept = rows.join(F.broadcast(gone) if few(gone, MOST_BROADCAST) else gone, rows.doc_id.eqNullSafe(F.col("gone")), "left_anti")
    return untagged(kept, docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that fail a rule of the current policy; null and empty texts fail."""
    lexicon = quality.learn_lexicon(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    led = quality.apply_policy(quality.with_ledger(tagged(docs, "text"), lexicon), quality.POLICIES["clean", 3])
    return untagged(led.where("kept"), docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts and brings n_chars up to date; every row stays, with an empty text if no line is left."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = names.index("doc_id"), names.index("text")
    rest = [i for i in range(len(names)) if i not in (key, text)]
    rows = flat.select(F.col(f"c{key}").alias("doc_id"), F.col(f"c{text}").alias("text"), *[F.col(f"c{i}") for i in rest])
    out = line_dedup.dedup_lines(spark, rows, extra=tuple(f"c{i}" for i in rest))
    return out.select(*[
        F.col("doc_id") if i == key else F.col("text") if i == text else F.length("text").cast(docs.dtypes[i][1]) if names[i] == "n_chars" else F.col(f"c{i}")
        for i in range(len(names))
    ]).toDF(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near copies: of the smallest doc_id (none comes last), its text of the smallest hash, and of its rows the first by their JSON."""
    classes = written(spark, near_dup.text_classes(spark, docs), f"{workspace(spark)}/classes")
    counted = classes.groupBy("doc_id", "own").agg(F.first("stays").alias("stays"), F.count("*").alias("n"))
    counted = written(spark, counted, f"{workspace(spark)}/counted")
    kept = without_texts(docs, counted.where("not stays"))
    repeated = counted.where("stays and n > 1")
    if repeated.isEmpty():
        return kept
    rows = with_text_key(kept)
    gone = repeated.select(F.col("doc_id").alias("r"), F.col("own").alias("s"))
    again = rows.join(gone, rows.doc_id.eqNullSafe(F.col("r")) & (rows.own == F.col("s")), "left_semi")
    one = again.groupBy("doc_id", "own").agg(F.min_by("row_", F.to_json("row_")).alias("row_"))  # JSON has an order for columns of any type
    return without_texts(kept, repeated).unionAll(untagged(one, docs.columns))


def with_text_key(docs: DataFrame) -> DataFrame:
    return tagged(docs, "doc_id", "text").select("row_", "doc_id", near_dup.text_hash(F.col("text")).alias("own"))


def without_texts(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """docs but for the rows with these doc_ids and text hashes; a null id matches a null one."""
    rows, gone = with_text_key(docs), texts.select(F.col("doc_id").alias("gone"), F.col("own").alias("hash"))
    kept = rows.join(F.broadcast(gone) if few(gone, MOST_BROADCAST) else gone, rows.doc_id.eqNullSafe(F.col("gone")) & (rows.own == F.col("hash")), "left_anti")
    return untagged(kept, docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontaminate.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.where("contaminated").select("doc_id").distinct())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of ids and decoded text."""
    return pieces.encode_documents(pick(docs, doc_id="", text="string"), tokenizer_path("piece_bpe_32k.model"), ("ids", "ids_sha256", "decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("minhash_near_dedup", near_dedup), ("benchmark_decontamination", drop_contaminated), ("sentencepiece", encode)]

#: SQL has no word for the tokenizer's merges; tests hold run() against a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), workspace(spark)
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

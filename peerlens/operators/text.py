"""Character n-gram TF-IDF vectors as long tables, and cosines through the shared n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vocabulary of so many grams is sent to the counts.
FEW = 100_000
#: Digits, and whatever is no letter, number or underscore in Unicode.
NOISE = r"[^\p{L}\p{N}_]|[0-9]"


def cleaned(docs: DataFrame) -> DataFrame:
    """doc, t (its texts without noise). Texts are shuffled only if there are documents of several rows, and then not a row for each gram."""
    t = F.regexp_replace("text", NOISE, "")
    if docs.groupBy("doc").count().where("count > 1").isEmpty():
        return docs.select("doc", F.array(t).alias("t"))
    return docs.groupBy("doc").agg(F.collect_list(t).alias("t"))


def _counted(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, dict[str, int]]]:
    """Each document, as an array of one, with the counts of its grams."""
    for b in batches:
        for i in range(len(b)):
            yield b.column("doc").slice(i, 1), Counter(t[j : j + n] for t in b.column("t")[i].as_py() if t for j in range(len(t) - n + 1))


def _rows(doc: pa.Array, grams: list[str], values: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc.take(pa.array([0] * len(grams), pa.int64())), pa.array(grams, pa.string()), values], ["doc", "gram", name])


def term_counts(docs: DataFrame, n: int) -> DataFrame:
    """doc, gram, tf from doc, text. A document's texts come together first and its grams are counted there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, found in _counted(batches, n):
            if found:
                yield _rows(doc, list(found), pa.array(list(found.values()), pa.int64()), "tf")

    return cleaned(docs).mapInArrow(count, f"doc {docs.schema['doc'].dataType.simpleString()}, gram string, tf bigint")


def vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """gram, df: the most frequent by document frequency, ties by gram."""
    return counts.groupBy("gram").agg(F.count("*").alias("df")).orderBy(F.desc("df"), F.asc("gram")).limit(size)


def tfidf(docs: DataFrame, n: int, size: int) -> DataFrame:
    """doc, gram, weight: tf * ln(N / df), unsmoothed, scaled to length 1. N counts documents without grams too; n-grams of every document weigh nothing and are left out.

    A vocabulary that is small enough goes to the documents, whose grams are counted and weighted in one place, so that no row is shuffled for a gram.
    """
    counts = term_counts(docs, n)  # made twice: counting a text again is less than a row for each of its grams on disk
    number = docs.agg(F.count("*").alias("n_docs"))
    vocab = vocabulary(counts, size).crossJoin(number).select("gram", F.ln(F.col("n_docs") / F.col("df")).alias("idf")).where("idf <> 0")  # one row on the right
    if size > FEW:
        raw = counts.join(vocab, "gram").select("doc", "gram", (F.col("tf") * F.col("idf")).alias("w"))
        each = raw.groupBy("doc").agg(F.collect_list(F.struct("gram", "w")).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))  # at most a vocabulary for each document
        return each.where("norm > 0").select("doc", "norm", F.explode("v").alias("x")).select("doc", "x.gram", (F.col("x.w") / F.col("norm")).alias("weight"))
    idf = {r.gram: r.idf for r in vocab.collect()}  # FEW rows at most

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, found in _counted(batches, n):
            grams = [g for g in found if g in idf]
            w = np.array([found[g] * idf[g] for g in grams])
            norm = np.sqrt((w * w).sum())
            if norm > 0:
                yield _rows(doc, grams, pa.array(w / norm), "weight")

    return cleaned(docs).mapInArrow(weigh, f"doc {docs.schema['doc'].dataType.simpleString()}, gram string, weight double")


def cosines(vectors: DataFrame, block: int = 256) -> DataFrame:
    """firm, peer, sim_text for all ordered pairs that share an n-gram.

    A join on n-grams makes a row for each n-gram of each pair; with a vocabulary that most texts share that is hundreds of millions for a thousand texts. So
    texts are put into blocks, and every two blocks meet in a task as two matrices of at most block x vocabulary numbers.
    """
    v = vectors.groupBy("doc").agg(F.collect_list(F.xxhash64("gram")).alias("grams"), F.collect_list("weight").alias("weights"))
    blocks = max(1, -(-vectors.select("doc").distinct().count() // block))
    v = v.withColumn("own", F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    v = v.select("doc", "grams", "weights", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        doc, own = t.column("doc").to_numpy(), t.column("own").to_numpy()
        grams, weights = (t.column(c).combine_chunks() for c in ("grams", "weights"))
        n = pc.list_value_length(grams).to_numpy()
        kinds, at = np.unique(grams.flatten().to_numpy(), return_inverse=True)
        m = np.zeros((len(doc), len(kinds)))
        m[np.repeat(np.arange(len(doc)), n), at] = weights.flatten().to_numpy()
        x, y = np.flatnonzero(own == key[0].as_py()), np.flatnonzero(own == key[1].as_py())
        sim = m[x] @ m[y].T
        p, q = np.nonzero((sim > 0) & (doc[x][:, None] != doc[y][None, :]))
        a, b, s = doc[x][p], doc[y][q], sim[p, q]
        if key[0] != key[1]:
            a, b, s = np.r_[a, b], np.r_[b, a], np.r_[s, s]
        return pa.table({"firm": pa.array(a, pa.int64()), "peer": pa.array(b, pa.int64()), "s": pa.array(s, pa.float64())})

    made = v.groupBy("i", "j").applyInArrow(run, "firm bigint, peer bigint, s double")
    return made.select("firm", "peer", F.round("s", 9).alias("sim_text"))


def text_sql(docs: str, n: int, size: int) -> str:
    """For DuckDB: tc, vocab, vec and textsim from a SELECT of doc, text."""
    return rf"""
docs0 AS ({docs}),
cleaned AS (SELECT doc, regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{N}}_]|[0-9]', '', 'g') AS t FROM docs0),
tc AS (SELECT doc, substring(t, i, {n}) AS gram, count(*) AS tf FROM (SELECT doc, t, unnest(range(1, length(t) - {n} + 2)) AS i FROM cleaned WHERE length(t) >= {n}) GROUP BY ALL),
vocab AS (SELECT gram, count(*) AS df FROM tc GROUP BY gram ORDER BY df DESC, gram LIMIT {size}),
vec0 AS (SELECT doc, gram, tf * ln((SELECT count(*) FROM docs0) / df) AS w FROM tc JOIN vocab USING (gram)),
norms AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM vec0 WHERE w <> 0 GROUP BY doc),
vec AS (SELECT doc, gram, w / norm AS weight FROM vec0 JOIN norms USING (doc) WHERE w <> 0 AND norm > 0),
textsim AS (SELECT a.doc AS firm, b.doc AS peer, round(sum(a.weight * b.weight), 9) AS sim_text FROM vec a JOIN vec b ON a.gram = b.gram AND a.doc <> b.doc GROUP BY ALL)
"""

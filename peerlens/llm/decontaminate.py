"""Benchmark decontamination as a prefix-filtered set join.

Each item is cut into windows of consecutive words, and a document is contaminated where a whole window occurs. Seen as a set join, the elements are
shingles (runs of up to three words), the records are windows, and the wanted containment is 1. Then the necessary prefix of a
window, with its shingles ordered by rarity in the corpus, is one shingle: its rarest. Shingles are only counted at first; then places of the rarest ones alone are
looked up, since only documents that hold a window's rarest shingle can hold the window. Length and position bounds discard places where the window would not fit; the words of each place left are compared one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_WORD, ascii_lower, few, pick, split_words, workspace, written

#: Words in a shingle, at most.
SHINGLE = 3


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), NON_WORD)


def shingle_hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """Distinct windows: win array<string>, len, item_ids; an item with fewer than `width` words, but not none, is one window."""
    w = pick(items, item_id="string", text="string").select("item_id", words_of(F.col("text")).alias("words"))
    w = w.withColumn("n", F.size("words")).where("n > 0")
    w = w.withColumn("start", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n") - width + 1, F.lit(1)))))
    return w.groupBy(F.slice("words", F.col("start"), F.lit(width)).alias("win")).agg(F.collect_set("item_id").alias("item_ids")).withColumn("len", F.size("win"))


def window_shingles(windows: DataFrame) -> DataFrame:
    """win, len, item_ids, size, off, h: every shingle of every window."""
    w = windows.withColumn("size", F.least("len", F.lit(SHINGLE)))
    w = w.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("size"))))
    h = reduce(lambda a, k: a.when(F.col("size") == k, shingle_hash(F.col("win"), F.col("off"), k)), range(2, SHINGLE + 1), F.when(F.col("size") == 1, shingle_hash(F.col("win"), F.col("off"), 1)))
    return w.withColumn("h", h)


def keyed(docs: DataFrame, size: int, *carried: str) -> DataFrame:
    """A row for each word of docs (one for a text without any): tkey, n, pos and key, the hash of the shingle that begins there, null past the last one."""
    d = docs.select("doc_id", F.xxhash64("text").alias("tkey"), words_of(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    e = d.select("doc_id", "tkey", "n", "words", F.posexplode_outer("words").alias("pos", "word"))
    return e.select("doc_id", "tkey", "n", "pos", F.when(F.col("pos") <= F.col("n") - size, shingle_hash(F.col("words"), F.col("pos"), size)).alias("key"), *carried)


def frequencies(docs: DataFrame, vocabulary: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """h, freq: how often the shingles of the vocabulary occur in the corpus; those that never do are missing. Counted before anything is shuffled."""
    parts = []
    for size in sizes:
        e = keyed(docs, size).where("key is not null").select("key")
        j = e.join(F.broadcast(vocabulary), F.col("key") == F.col("h")) if small else e.groupBy("key").agg(F.count("*").alias("c")).join(vocabulary, F.col("key") == F.col("h"))
        parts.append(j.groupBy("h").agg((F.count("*") if small else F.sum("c")).alias("freq")))
    return reduce(DataFrame.unionByName, parts).groupBy("h").agg(F.sum("freq").alias("freq"))


def occurrences(docs: DataFrame, vocabulary: DataFrame, sizes: list[int], width: int, small: bool) -> DataFrame:
    """Places of shingles of the vocabulary, with the words around them; and one row without h for each row of docs.

    Columns: doc_id, tkey, n, pos, h, from, around. With a small vocabulary all happens in one stage without a shuffle. With a large one, only
    hashes are shuffled, and the words around come from the documents that have a hit.
    """
    first = F.greatest(F.col("pos") - (width - 1), F.lit(0))
    around = F.slice("words", first + 1, F.lit(2 * width - 1))
    parts = []
    for k, size in enumerate(sizes):
        row = F.coalesce("pos", F.lit(0)) == 0 if k == 0 else F.lit(False)
        e = keyed(docs, size, *(["words"] if small else [])).withColumn("row", row)
        v = F.broadcast(vocabulary) if small else vocabulary
        j = e.join(v, F.col("key") == F.col("h"), "left").where(F.col("row") | F.col("h").isNotNull())
        parts.append(j.select("doc_id", "tkey", "n", "pos", "row", "h", *([first.alias("from"), F.when(F.col("h").isNotNull(), around).alias("around")] if small else [])))
    found = reduce(DataFrame.unionByName, parts)
    if small:
        return found
    hit = found.where("h is not null").groupBy("doc_id", "tkey", "n").agg(F.collect_set(F.struct("pos", "h")).alias("at"))
    d = docs.select("doc_id", F.xxhash64("text").alias("tkey"), words_of(F.col("text")).alias("words"))
    texts = d.dropDuplicates(["doc_id", "tkey"]).select(F.col("doc_id").alias("d"), F.col("tkey").alias("t"), "words")
    wide = hit.join(texts, hit.doc_id.eqNullSafe(F.col("d")) & hit.tkey.eqNullSafe(F.col("t"))).select("doc_id", "tkey", "n", "words", F.explode("at").alias("at"))
    wide = wide.select("doc_id", "tkey", "n", F.col("at.pos").alias("pos"), F.lit(False).alias("row"), F.col("at.h").alias("h"), "words").withColumn("from", first).withColumn("around", around).drop("words")
    none = found.where("row").withColumns({"h": F.lit(None).cast("bigint"), "from": F.lit(None).cast("int"), "around": F.lit(None).cast("array<string>")})
    return none.unionByName(wide)


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = 10, most_broadcast: int = 500_000) -> DataFrame:
    """Judges every row of docs against the windows of `width` words of all items.

    Returns doc_id, n_words, n_hit (words inside any occurrence), item_ids (array, sorted as strings), spans (array of (start, end) word positions), contaminated.
    A null or empty text has no words and isn't contaminated; null or empty items have no window. Items without an id
    mark words but aren't named. Repeated rows give repeated rows; rows that share a doc_id are judged each by its text. Empty tables are allowed; further columns are ignored.
    Texts are searched whole: a long one is so many rows of words, of which the places that match alone go on.
    """
    docs = pick(docs, doc_id="", text="string")
    at = workspace(spark)
    windows = written(spark, window_shingles(item_windows(items, width)), f"{at}/windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect()) or [SHINGLE]  # SHINGLE values at most
    vocabulary = windows.select("h").distinct()
    small = few(vocabulary, most_broadcast)

    # Rarity over the whole corpus; a window whose rarest shingle occurs nowhere is dropped.
    rarity = written(spark, frequencies(docs, vocabulary, sizes, small), f"{at}/rarity")
    ranked = windows.join(F.broadcast(rarity) if small else rarity, "h", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    prefix = ranked.groupBy("win", "len").agg(F.min(F.struct("freq", "h", "off")).alias("p"), F.first("item_ids").alias("item_ids"))
    prefix = written(spark, prefix.where("p.freq > 0").select(F.col("p.h").alias("h"), F.col("p.off").alias("off"), "win", "len", "item_ids"), f"{at}/prefix")
    rarest = prefix.select("h").distinct()
    small = few(rarest, most_broadcast) and few(prefix, most_broadcast)
    places = written(spark, occurrences(docs, rarest, sizes, width, small), f"{at}/places")
    c = places.where("h is not null").join(F.broadcast(prefix) if small else prefix, "h")
    c = c.withColumn("start", F.col("pos") - F.col("off")).where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
    c = c.where(F.slice("around", F.col("start") - F.col("from") + 1, F.col("len")) == F.col("win"))
    hits = c.select("doc_id", "tkey", "n", F.lit(0).alias("row"), F.struct("start", (F.col("start") + F.col("len")).alias("end")).alias("span"), "item_ids")
    rows = places.where("row").select("doc_id", "tkey", "n", F.lit(1).alias("row"), F.lit(None).cast("struct<start:int,end:int>").alias("span"), F.lit(None).cast("array<string>").alias("item_ids"))
    per = rows.unionByName(hits).groupBy("doc_id", "tkey").agg(F.max("n").alias("n"), F.sum("row").alias("copies"), F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    grown = F.aggregate("spans", zero, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")), lambda a: a["n"])
    out = per.select("doc_id", F.col("n").cast("bigint").alias("n_words"), grown.cast("bigint").alias("n_hit"), "item_ids", "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth"))
    return out.select("doc_id", "n_words", "n_hit", "item_ids", "spans", (F.col("n_hit") > 0).alias("contaminated"))

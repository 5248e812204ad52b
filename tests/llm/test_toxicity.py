"""The learned rule for toxic texts."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from peerlens.llm import quality

CLEAN = "der schnelle braune fuchs springt heute wieder über den faulen hund im garten nummer {}"


def tables(spark):
    docs = [(i, CLEAN.format(f"x{i}") + (" du mieser schuft" if i < 6 else "")) for i in range(40)]
    labels = [(i, 1, int(i < 6)) for i in range(30)]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_words_of_any_language_are_learned_and_judged_by_their_share(spark, tmp_path):
    docs, labels = tables(spark)
    lexicon = quality.learn_lexicon(docs, labels)
    assert set(lexicon) == {"du", "mieser", "schuft"}
    new = spark.createDataFrame([(1, CLEAN.format("neu") + " du mieser Schuft"), (2, " ".join(CLEAN.format(f"{i} y{i}") for i in range(30)) + " schuft du"), (3, CLEAN.format("drei")), (4, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality.apply_policy(quality.ledger(new, lexicon), quality.POLICIES["clean", 3]).collect()}
    bit = 1 << quality.TOXIC.bit
    assert got[1].n_toxic == 3 and got[1].failures & bit and not got[1].kept
    assert got[2].n_toxic == 2 and not got[2].failures & bit and got[3].kept and not got[4].failures & bit
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, new, str(tmp_path)).collect()} & {1, 3} == {3}


def test_without_labels_there_are_no_words(spark):
    docs, labels = tables(spark)
    assert quality.learn_lexicon(docs, labels.limit(0)) == [] == quality.learn_lexicon(docs, labels.withColumn("toxic", F.lit(0)))
    assert quality.ledger(docs, []).where("n_toxic > 0").count() == 0


def test_no_word_is_left_out(spark):
    """12,000 toxic words, each in four texts: as a list and as a table they give the same ledger."""
    bad = [f"q{i}" for i in range(12_000)]
    docs = spark.createDataFrame([(i, " ".join(bad)) for i in range(4)] + [(i, CLEAN.format(i)) for i in range(4, 200)], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(200)], "doc_id bigint, toxic int")
    listed, table = quality.learn_lexicon(docs, labels), quality.learn_lexicon(docs, labels, listed=11_999)
    assert listed == sorted(bad) == sorted(r.word for r in table.collect())
    new = spark.createDataFrame([(1, "q11999 q0 q0 x"), (1, "q11999 q0 q0 x"), (2, None), (3, ""), (4, "Q5 q12000 q11998"), (5, CLEAN)], "doc_id bigint, text string")
    rows = [sorted(map(tuple, quality.ledger(new, x).select("doc_id", "n_plain", "n_toxic", "failures").collect())) for x in (listed, table)]
    assert rows[0] == rows[1] and [r[1:3] for r in rows[0]] == [(4, 3), (4, 3), (0, 0), (0, 0), (3, 2), (14, 0)]

"""Quality rules as a ledger of bits.

ledger() evaluates every rule once and stores its failure bit together with the measurements. A policy is a named, versioned
mask; applying it is one bitwise AND, and ablations only aggregate the stored bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD, SPACES, ascii_lower, pick, split_words, workspace, written


def measures() -> dict[str, Column]:
    """Measurements over the columns text, words, lines and grams (hashes of 5-word windows)."""
    t = F.coalesce("text", F.lit(""))
    n = F.size("words")
    nonblank = F.filter(F.col("lines"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": n.cast("bigint"),
        "word_chars": F.length(F.array_join("words", "")).cast("bigint"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "n_bangs": F.regexp_count(t, F.lit("!!")).cast("bigint"),
        "n_upper": F.regexp_count(t, F.lit("[A-Z]")).cast("bigint"),
        "n_lines": F.size(nonblank).cast("bigint"),
        "n_dup_lines": (F.size(nonblank) - F.size(F.array_distinct(nonblank))).cast("bigint"),
        "n_repeat_words": repeat_words(F.col("grams")).cast("bigint"),
    }


def repeat_words(grams: Column, width: int = 5) -> Column:
    """Words inside windows that occur twice or more; the sort runs only for texts that have such windows."""
    at = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), covered(repeated_places(at), width)).otherwise(F.lit(0))


def repeated_places(at: Column) -> Column:
    """Places of windows that have an equal neighbour in the sorted list; the list is zipped with itself, shifted by one either way."""
    none = F.array(F.lit(None).cast("struct<g:bigint,i:int>"))
    before, after = F.concat(none, F.slice(at, F.lit(1), F.size(at) - 1)), F.concat(F.slice(at, F.lit(2), F.size(at)), none)
    first = F.zip_with(at, before, lambda x, b: F.struct(x["g"].alias("g"), x["i"].alias("i"), F.coalesce(x["g"] == b["g"], F.lit(False)).alias("again")))
    return F.sort_array(F.array_compact(F.zip_with(first, after, lambda x, a: F.when(x["again"] | (x["g"] == a["g"]), x["i"]))))


def covered(places: Column, width: int) -> Column:
    """How many positions the windows that start at these sorted places cover."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(places, zero, lambda a, i: F.struct((a["n"] + i + width - F.greatest(i, a["end"])).alias("n"), (i + width).alias("end")), lambda a: a["n"])


@dataclass(frozen=True)
class Rule:
    """A document fails where `failed` holds; `bit` never changes once it has been used."""

    name: str
    bit: int
    failed: str


#: The ledger's rules; bits are stable across versions. Bit 7 was a fixed list of words and isn't used again.
RULES = [
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > 3 * n_words"),
    Rule("bangs", 3, "10 * n_bangs > 2 * n_words"),
    Rule("capitals", 4, "10 * n_upper > 6 * word_chars"),
    Rule("repeated_lines", 5, "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", 6, "word_chars > 20 * n_words or 10 * word_chars < 15 * n_words"),
]
#: Needs a lexicon, see with_ledger(); the ledger without one doesn't have it.
TOXIC = Rule("toxic", 8, "n_toxic > 0 and 100 * n_toxic >= n_plain")
BITS = {r.name: r.bit for r in [*RULES, TOXIC]}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BITS[r] for r in self.rules)


POLICIES = {
    ("base", 1): Policy("base", 1, ("few_words", "repeated_windows")),
    ("clean", 1): Policy("clean", 1, tuple(r.name for r in RULES)),
    ("clean", 3): Policy("clean", 3, (*[r.name for r in RULES], "toxic")),
}

#: Of the labelled rows at most so many are learned from; a word counts from so many toxic texts on, and from so many times its share of the others.
LABELLED, LEAST, RATIO = 200_000, 4, 20
#: So many learned words go into the plan as a list; more of them stay a table that texts' words are joined with. The result is the same.
LISTED = 200_000

Lexicon = list[str] | DataFrame


def plain_words(text: Column) -> Column:
    return split_words(ascii_lower(text), NON_WORD)


def learn_lexicon(docs: DataFrame, labels: DataFrame, rows: int = LABELLED, least: int = LEAST, ratio: int = RATIO, listed: int = LISTED) -> Lexicon:
    """Words of toxic texts of any language: in `least` labelled toxic texts or more, and in a share of them that is `ratio` times that of the others.

    At most `rows` labelled rows, drawn by a hash of doc_id, are read. All words found are returned: up to `listed` of them as a list, else as a table with the column
    `word`. Without labelled toxic texts there are none.
    """
    known = pick(labels, doc_id="", toxic="int").where("toxic is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    d = pick(docs, doc_id="", text="string").join(F.broadcast(known), "doc_id").select((F.col("toxic") == 1).alias("toxic"), F.array_distinct(plain_words(F.col("text"))).alias("words"))
    each = d.select("toxic", F.explode(F.concat(F.array(F.lit("")), "words")).alias("word")).groupBy("word").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c"))
    sizes = F.broadcast(each.where("word = ''").select(F.col("t").alias("all_t"), F.col("c").alias("all_c")))  # one row: every text has the empty word once
    found = each.where("word <> ''").crossJoin(sizes).where((F.col("t") >= least) & (F.col("t") * (F.col("all_c") + 1) >= ratio * (F.col("c") + 0.5) * (F.col("all_t") + 1))).select("word")
    first = [r.word for r in found.limit(listed + 1).collect()]
    return sorted(first) if len(first) <= listed else written(docs.sparkSession, found, f"{workspace(docs.sparkSession)}/lexicon")


def with_toxic_words(w: DataFrame, lexicon: Lexicon) -> DataFrame:
    """w, which has a column text, with n_plain and n_toxic: how many words a text has, and how many of them are in the lexicon."""
    if not isinstance(lexicon, DataFrame):
        w = w.withColumn("plain", plain_words(F.col("text")))
        return w.withColumns({"n_plain": F.size("plain").cast("bigint"), "n_toxic": F.size(F.filter("plain", lambda x: x.isin(lexicon))).cast("bigint")}).drop("plain")
    w = w.withColumn("text_key", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    texts = w.groupBy("text_key").agg(F.first("text").alias("text"))  # copies are counted once
    words = texts.select("text_key", F.explode(plain_words(F.col("text"))).alias("word")).groupBy("text_key", "word").agg(F.count("*").alias("n"))
    counted = words.join(lexicon, "word", "left_semi").groupBy("text_key").agg(F.sum("n").alias("n_toxic"))
    w = w.join(counted, "text_key", "left").drop("text_key")
    return w.withColumns({"n_plain": F.size(plain_words(F.col("text"))).cast("bigint"), "n_toxic": F.coalesce("n_toxic", F.lit(0)).cast("bigint")})


def with_ledger(df: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """df, which has a column text, with all measurements and the bit mask `failures`; with a lexicon also n_plain, n_toxic and the rule `toxic`.

    Each step is a projection of its own, so that words, lines and window hashes are made once for each document.
    """
    words, lines = split_words(F.col("text"), SPACES), F.split(F.coalesce("text", F.lit("")), "\n")
    w = df.withColumns({"words": words, "lines": lines})
    w = w.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))
    h = F.col("hashes")
    windows = F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))
    w = w.withColumn("grams", F.when(F.size(h) >= 5, windows).otherwise(F.array().cast("array<bigint>")))
    w = w.withColumns(measures())
    if lexicon is not None:
        w = with_toxic_words(w, lexicon)
    rules = RULES if lexicon is None else [*RULES, TOXIC]
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint") for r in rules])
    # A generator of one row: filters on the mask stay above it. Pushed below, they would repeat all that goes into it, once for each use.
    return w.select("*", F.explode(F.array(mask)).alias("failures")).drop("words", "lines", "hashes", "grams")


def ledger(docs: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """doc_id, measurements and failure bits of every row of docs.

    A null text has no words; empty texts fail few_words alone. Rows are judged one by one: ties and repeated rows stay. A text is measured
    whole, in one task, however long. Further columns are ignored.
    """
    return with_ledger(pick(docs, doc_id="", text="string"), lexicon).drop("text")


def apply_policy(led: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with `kept`: no rule of the policy failed."""
    return led.withColumn("kept", F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(led: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: how many documents fail it, fail it alone, and would be kept without it. Reads the masks only.

    The masks are counted first, so the rest sees at most 2^rules rows.
    """
    masks = led.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask)).alias("m")).agg(F.count("*").alias("n"))
    one = [F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("bigint").alias("bit")) for r in policy.rules]
    each = masks.select("m", "n", F.explode(F.array(*one)).alias("r"))
    has = F.col("m").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("m") == F.col("r.bit")
    kept = F.col("m").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(total(has).alias("n_failed"), total(alone).alias("n_only"), total(kept).alias("n_kept_without"), F.sum("n").alias("n_docs"))

"""Near-duplicate documents by ProbMinHash over weighted shingles.

Each shingle of a text is a Poisson process of arrivals, at a rate equal to its weight, and each arrival falls into one slot. The first arrival in each
slot makes the signature; a shingle's process stops as soon as its next arrival is later than all slots' first ones. Slots of two texts agree
with their probability Jaccard similarity; with equal weights that is the Jaccard similarity. Bands of slots propose pairs, which are verified on the whole texts.

Pairs within a bucket are never all written out. Every text is first compared with its bucket's smallest member, and verified pairs are joined into
components. Only in buckets that still hold several components are signatures compared further, block by block; of the pairs that may be similar, a spanning forest
is kept. The trees of all buckets together make neighbourhoods. The texts of a neighbourhood meet once, again block by block, and every pair across
components that may be similar is verified there, the most likely first, until the components it would join are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import few, pick, release, slices, workspace, written
from .components import Sets, components
from .decontaminate import words_of
from .mph import mix

#: Slots are BANDS * ROWS. At similarity 0.8 a pair shares no band with probability (1 - 0.8^6)^32 = 6e-5, at 0.85 with 8e-8.
BANDS, ROWS = 32, 6
#: Pairs whose signatures agree in less than this share of slots are dropped unverified: at 0.8 that is 4.2 standard deviations below, one pair in 60,000.
LEAST_ESTIMATE = 0.68
#: Stands for a missing doc_id where texts are looked up by doc_id and hash; the hash alone tells such texts apart.
LAST = (1 << 63) - 1
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(tokens: np.ndarray, lengths: np.ndarray, width: int, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, their weights, and the text each belongs to, ascending by text.

    A text with fewer words than `width`, but some, is one shingle. weights: "count" for the number of occurrences, "one" for all the same.
    """
    n = len(tokens)
    start = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(n) - np.repeat(start, lengths)
    left = np.repeat(lengths, lengths) - place
    h = np.zeros(n, np.uint64)
    padded = np.concatenate([tokens.astype(np.uint64), np.zeros(width, np.uint64)])
    for k in range(width):
        h = np.where(left > k, mix(h * GOLD + padded[k : n + k] + np.uint64(k + 1)), h)
    ok = (left >= width) | (place == 0)
    h, doc = h[ok], doc[ok]
    _, at, counts = np.unique(mix(h ^ mix(doc.astype(np.uint64) + GOLD)), return_index=True, return_counts=True)
    order = np.argsort(doc[at], kind="stable")
    at, counts = at[order], counts[order]
    return h[at], counts.astype(np.float64) if weights == "count" else np.ones(len(at)), doc[at]


def signatures(elem: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """docs x slots: the shingle with the first arrival in each slot; 0 in texts without shingles.

    Texts are handled in classes of size. Each step makes so many arrivals of each shingle as a class needs about to fill its slots; then shingles that are too late drop out.
    """
    out = np.zeros((docs, slots), np.uint64)
    sizes = np.bincount(doc, minlength=docs)
    kind = np.where(sizes > 0, np.minimum(np.log2(np.maximum(sizes, 1)).astype(np.int64), 8), -1)
    enough = slots * (np.log(slots) + 2)
    for k in np.unique(kind[kind >= 0]).tolist():
        own = np.flatnonzero(kind == k)
        number = np.full(docs, -1)
        number[own] = np.arange(len(own))
        pick_ = number[doc] >= 0
        e, w, d = elem[pick_], weight[pick_], number[doc[pick_]]
        step = 1 if k == 8 else int(np.ceil(enough / (1 << k)))
        best, arg = np.full(len(own) * slots, np.inf), np.zeros(len(own) * slots, np.uint64)
        time, arrivals = np.zeros(len(e)), 0
        while len(e):
            r = mix(e[:, None] + (np.arange(arrivals, arrivals + step, dtype=np.uint64) + np.uint64(1)) * GOLD)
            gaps = -np.log(((r >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)) / w[:, None]
            t = time[:, None] + np.cumsum(gaps, axis=1)
            slot = d[:, None] * slots + (mix(r ^ GOLD) % np.uint64(slots)).astype(np.int64)
            t1, s1, e1 = t.ravel(), slot.ravel(), np.repeat(e, step)
            better = np.flatnonzero(t1 < best[s1])
            better = better[np.argsort(-t1[better], kind="stable")]  # of several for one slot the earliest is written last
            best[s1[better]], arg[s1[better]] = t1[better], e1[better]
            late = best.reshape(-1, slots).max(axis=1)
            time, arrivals = t[:, -1], arrivals + step
            stay = time < late[d]
            e, w, d, time = e[stay], w[stay], d[stay], time[stay]
        out[own] = arg.reshape(-1, slots)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two texts' (ascending shingles, weights): sum over shared x of 1 / sum over y of max(a_y / a_x, b_y / b_x)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    wa, wb = a[1][i], b[1][j]
    ratio = wa / wb
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    order = np.argsort(ratio)
    ra, rb, r = wa[order], wb[order], ratio[order]
    # For x, the y of a larger ratio count by a, the others by b; y that one text alone holds always count.
    up_to = np.searchsorted(r, r, side="right")
    below, above = np.r_[0, np.cumsum(rb)][up_to], ra.sum() - np.r_[0, np.cumsum(ra)][up_to]
    return float((1 / ((only_a + above) / ra + (only_b + below) / rb)).sum())


def _tokens(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def texts_of(docs: DataFrame, wanted: DataFrame, most_broadcast: int) -> DataFrame:
    """The rows of wanted (with key and own, a doc_id and the hash of a text of it) with that text, once however often docs repeat it."""
    t = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("key"), text_hash(F.col("text")).alias("own"), "text")
    names = [c for c in wanted.columns if c not in ("key", "own")]
    found = t.join(F.broadcast(wanted) if few(wanted, most_broadcast) else wanted, ["key", "own"])
    return found.select(*names, "text").dropDuplicates([c for c in names if c != "sig"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), lengths


def sketch(docs: DataFrame, width: int, weights: str) -> DataFrame:
    """doc_id, own (hash of the text), a, b (128 bits of the shingles and their counts; of the text if it has no words), n (distinct shingles), bands, sig (16 bits of each slot) of each row."""
    slots = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "tokens", 300, 100_000):
            elem, weight, doc = shingles(*_lists(batch.column("tokens")), width, weights)
            n = np.bincount(doc, minlength=len(batch))
            sig = signatures(elem, weight, doc, len(batch), slots)
            w = weight.astype(np.uint64)
            ends = np.r_[0, np.cumsum(n)]
            sums = [np.r_[np.uint64(0), np.cumsum(mix(elem + np.uint64(s)) * (w * np.uint64(2) + np.uint64(1)), dtype=np.uint64)] for s in (1, 2)]
            a, b = (mix(s[ends[1:]] - s[ends[:-1]] + n.astype(np.uint64)).view(np.int64) for s in sums)
            own = batch.column("own").to_numpy(zero_copy_only=False)
            a, b = np.where(n > 0, a, own), np.where(n > 0, b, -1)
            h = np.zeros((len(batch), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for k in range(ROWS):
                h = mix(h * GOLD + sig.reshape(len(batch), BANDS, ROWS)[:, :, k])
            bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(n > 0, BANDS, 0))].astype(np.int32)), pa.array(h[n > 0].ravel().view(np.int64)))
            short = [x.tobytes() for x in (mix(sig) >> np.uint64(48)).astype(np.uint16)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("own"), pa.array(a), pa.array(b), pa.array(n.astype(np.int64)), bands, pa.array(short, pa.binary())], ["doc_id", "own", "a", "b", "n", "bands", "sig"])
        release()

    d = docs.select("doc_id", text_hash(F.col("text")).alias("own"), _tokens(F.col("text")).alias("tokens"))
    return d.mapInArrow(run, "doc_id bigint, own bigint, a bigint, b bigint, n bigint, bands array<bigint>, sig binary")


def agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose signatures agree well enough to be verified."""
    s = nodes.select("node", "sig")
    j = pairs.join(s.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b").join(s.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(batch), BANDS * ROWS) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= LEAST_ESTIMATE))

    return j.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint")


class ShingleSets:
    """(ascending shingles, weights) of the texts of a column of tokens, made when they are asked for; about so many of them are kept."""

    def __init__(self, tokens: pa.ChunkedArray, width: int, weights: str, most: int = 2_000_000):
        self.tokens, self.width, self.weights, self.most = tokens, width, weights, most
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.size = 0

    def __call__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.known:
            flat, lengths = _lists(self.tokens.slice(k, 1))
            e, w, _ = shingles(flat, lengths, self.width, self.weights)
            order = np.argsort(e)
            if self.size > self.most:
                self.known, self.size = {}, 0
            self.known[k] = e[order], w[order]
            self.size += len(e)
        return self.known[k]


def verified(pairs: DataFrame, docs: DataFrame, places: DataFrame, width: int, weights: str, threshold: float, most: int = 500_000, most_broadcast: int = 300_000) -> DataFrame:
    """Those of the pairs (a, b; many b for each a) whose whole texts are similar enough; places: node, key, own, n.

    Texts meet in groups of an a and those of its b that have about so many shingles together; the text of an a with more of them is sent to each of its groups.
    """
    p = pairs.join(places.select(F.col("node").alias("b"), "n"), "b")
    sizes = p.groupBy("a").agg(F.ceil(F.sum("n") / most).alias("parts"))
    p = p.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    wanted = p.select("a", "part", F.col("b").alias("node")).unionByName(p.select("a", "part", F.col("a").alias("node")).distinct())
    rows = texts_of(docs, wanted.join(places.drop("n"), "node"), most_broadcast).repartition("a", "part")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        a, keys, sets = key[0].as_py(), t.column("node").to_numpy(), ShingleSets(t.column("tokens"), width, weights, 0)
        own = [sets(i) for i in np.flatnonzero(keys == a).tolist()]
        found = {int(keys[i]) for i in np.flatnonzero(keys != a).tolist() for x in own if similarity(x, sets(i)) >= threshold}
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(sorted(found), pa.int64())})

    return rows.select("a", "part", "node", _tokens(F.col("text")).alias("tokens")).groupBy("a", "part").applyInArrow(run, "a bigint, b bigint")


def blocks_of(members: DataFrame, sizes: DataFrame, key: str, block: int) -> DataFrame:
    """Members of a key in blocks of about so many, each row sent to every pair (i <= j) of blocks that its own is in; sizes: a stored table of keys and their numbers of members."""
    blocks = sizes.select(key, F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    m = members.join(F.broadcast(blocks) if few(sizes, 1_000_000) else blocks, key).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return m.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks")


def _likely(t: pa.Table, i: int, j: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of block i the rows of block j, of another component, whose signatures agree well enough, and the shares."""
    node, root, own = (t.column(c).to_numpy() for c in ("node", "root", "own"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(node), -1)
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for x in left.tolist():
        y = right[(node[right] > node[x]) & (root[right] != root[x])] if i == j else right[root[right] != root[x]]
        same = (sig[y] == sig[x]).mean(axis=1)
        ok = same >= LEAST_ESTIMATE
        yield x, y[ok], same[ok]


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([min(p) for p in pairs], pa.int64()), "b": pa.array([max(p) for p in pairs], pa.int64())})


def across(members: DataFrame, sizes: DataFrame, block: int = 512) -> DataFrame:
    """Spanning forest (a, b) of the pairs of one bucket that are in different components and may be similar; members: bucket, node, root, sig."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        sets, node = Sets(), t.column("node").to_pylist()
        return _links([(node[x], node[y]) for x, ys, _ in _likely(t, key[1].as_py(), key[2].as_py()) for y in ys.tolist() if sets.join(x, y)])

    m = blocks_of(members, sizes, "bucket", block).select("bucket", "i", "j", "own", "node", "root", "sig")
    return m.groupBy("bucket", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def settled(members: DataFrame, sizes: DataFrame, width: int, weights: str, threshold: float, block: int = 512) -> DataFrame:
    """Links (a, b) that join components within a neighbourhood; members: near, node, root, sig, tokens."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        likely = [(s, x, y) for x, ys, shares in _likely(t, key[1].as_py(), key[2].as_py()) for y, s in zip(ys.tolist(), shares.tolist(), strict=True)]
        node, root, sets, out, part = t.column("node").to_pylist(), t.column("root").to_pylist(), Sets(), [], ShingleSets(t.column("tokens"), width, weights)
        for _, x, y in sorted(likely, reverse=True):
            if sets.top(root[x]) != sets.top(root[y]) and similarity(part(x), part(y)) >= threshold:
                sets.join(root[x], root[y])
                out.append((node[x], node[y]))
        return _links(out)

    m = blocks_of(members, sizes, "near", block).select("near", "i", "j", "own", "node", "root", "sig", "tokens")
    return m.groupBy("near", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, threshold: float = 0.8, weights: str = "count") -> DataFrame:
    """doc_id and class_id of every row of docs; rows with one class_id are those whose texts links of at least `threshold` connect.

    class_id is the smallest doc_id of the class. A class without any doc_id, or whose smallest doc_id already names another class (a doc_id with
    several texts), has a negative number made of its texts' hashes instead. Further columns are ignored. See text_classes().
    """
    return text_classes(spark, docs, width, threshold, weights).select("doc_id", "class_id")


def text_classes(spark: SparkSession, docs: DataFrame, width: int = 5, threshold: float = 0.8, weights: str = "count") -> DataFrame:
    """doc_id, own (text_hash of the text), class_id, stays (whether doc_id and own are those of the class's first text) of every row of docs.

    Words are lower-cased (A-Z) runs of letters, digits and characters past ASCII; a text with fewer than `width` words is one shingle. Texts without words,
    null among them, are in one class only with equal texts (null equals empty). Texts are what is linked: rows that share a doc_id, or have none, are in one
    class only if their texts are similar. The first text of a class has its smallest doc_id (none comes last) and of that the smallest hash. Empty tables are allowed;
    further columns are ignored. Texts are compared whole, however long; batches go by tokens, and a long text is one by itself. doc_ids are numbers (or text of digits, which is cast).
    """
    docs = pick(docs, doc_id="bigint", text="string")
    at = workspace(spark)
    rows = written(spark, sketch(docs, width, weights), f"{at}/rows")
    # A node is a distinct text; `least` is the first row of it. The numbers hold because the table is written.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own"))
    copies = written(spark, rows.groupBy("a", "b").agg(least.alias("least"), F.first("n").alias("n")).withColumn("node", F.monotonically_increasing_id()), f"{at}/copies")
    key = lambda c: F.coalesce(c, F.lit(LAST))
    places = copies.select("node", key(F.col("least.doc_id")).alias("key"), F.col("least.own").alias("own"), "n")
    nodes = rows.where("n > 0").withColumn("key", key(F.col("doc_id"))).join(copies.select("a", "b", "node", key(F.col("least.doc_id")).alias("key"), F.col("least.own").alias("own")), ["a", "b", "key", "own"])
    nodes = written(spark, nodes.select("node", "bands", "sig").dropDuplicates(["node", "bands"]), f"{at}/nodes")

    banded = nodes.select(F.explode("bands").alias("bucket"), "node")
    buckets = written(spark, banded.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("members")).where("members > 1"), f"{at}/buckets")
    stars = written(spark, agreeing(banded.join(buckets, "bucket").where("node > a").select("a", F.col("node").alias("b")).distinct(), nodes), f"{at}/stars")
    links = written(spark, verified(stars, docs, places, width, weights, threshold), f"{at}/links")
    first = components(spark, links)

    labelled = nodes.join(first, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "bands", "sig")
    labelled = written(spark, labelled, f"{at}/labelled")
    spread = labelled.select("node", "root", F.explode("bands").alias("bucket"))
    # Two members were compared above. Summed before the shuffle, so that a bucket of very many texts is a row from each task.
    mixed = spread.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).where("members > 2 and low < high").select("bucket", "members")
    mixed = written(spark, mixed, f"{at}/mixed")
    wanted = F.broadcast(mixed.select("bucket")) if few(mixed, 1_000_000) else mixed.select("bucket")
    once = labelled.select("node", "root", "sig")
    near = written(spark, across(spread.select("bucket", "node", "root").join(wanted, "bucket").join(once.drop("root"), "node"), mixed), f"{at}/near")
    if not near.isEmpty():
        hoods = components(spark, near)
        members = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(hoods, "node", "left").select("node", F.coalesce("root", "node").alias("near"))
        members = written(spark, members.join(once, "node").join(places.drop("n"), "node"), f"{at}/members")
        sizes = written(spark, members.groupBy("near").agg(F.count("*").alias("members")), f"{at}/sizes")
        texts = texts_of(docs, members, 20_000).select("near", "node", "root", "sig", _tokens(F.col("text")).alias("tokens"))
        more = written(spark, settled(texts, sizes, width, weights, threshold), f"{at}/more")
        first = components(spark, links.unionByName(more))
    named = copies.join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = named.groupBy("root").agg(F.min("least").alias("first"))
    # Of classes with one smallest doc_id the one of the smallest hash is named by it; classes without a doc_id are apart.
    again = F.row_number().over(Window.partitionBy("first.doc_id", F.when(F.col("first.none"), F.col("root"))).orderBy("first.own", "root"))
    other = -(F.col("first.own").bitwiseAND(F.lit((1 << 62) - 1))) - 1
    classes = classes.withColumn("again", again).withColumn("class_id", F.when(~F.col("first.none") & (F.col("again") == 1), F.col("first.doc_id")).otherwise(other))
    found = named.select("a", "b", "root").join(classes.select("root", "class_id", "first"), "root").select("a", "b", "class_id", "first")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("own") == F.col("first.own"))
    return rows.select("doc_id", "own", "a", "b").join(found, ["a", "b"]).select("doc_id", "own", "class_id", stays.alias("stays"))

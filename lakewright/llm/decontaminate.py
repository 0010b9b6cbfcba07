"""Benchmark decontamination by SimHash windows.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
lower-cased.  For an item of L words, a document's windows are all its runs of
L consecutive words; a document of fewer than L words is one window.  A
window's weighted shingles (5 words, weight = number of occurrences) give a
64-bit SimHash.  Eight blocks of eight bits index the items' fingerprints:
each block is listed with all its values within two bits, so that two
fingerprints at most 23 bits apart share an entry for certain.
Candidates within that radius are decided by their exact weighted Jaccard
similarity, at least ``threshold`` percent.

A window of n shingles as similar as the threshold asks has at most
n * (100 - threshold) / (100 + threshold) that its item has not, in whatever
order.  So every window is fingerprinted in which the remaining places hold a
shingle of some item of that length; no other can match.  Shared shingles are
looked up at every third word if that leaves one for certain, else at every
word.

Only DataFrame functions are used.  Defined results: null, empty and blank
texts and items match nothing; an item of fewer than 5 words is one shingle;
repeated rows report alike, once a doc_id; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import docs_of, stage
from lakewright.llm.license_scan import words_of

WORDS = 5
THRESHOLD = 80
RADIUS = 23
BROADCAST_ROWS = 500_000            # shingles of all items up to which they are sent to every task


def _hash(i: Column, k: int, words: str = "words") -> Column:
    return F.xxhash64(*[F.get(F.col(words), i + j) for j in range(k)])


def _shingles(words: str, k: int, stride: int = 1) -> Column:
    """Shingle hashes at every ``stride``-th word of ``words``."""
    last = F.size(words) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda i: _hash(i, k, words)))


def simhash(shingles: str) -> Column:
    """64-bit SimHash of an array of shingle hashes (repeats weigh more)."""
    return F.expr(f"""aggregate(sequence(0, 63), 0L, (acc, b) -> acc | shiftleft(CAST(
        aggregate({shingles}, 0, (s, h) -> s + CAST(shiftright(h, b) & 1L AS INT) * 2 - 1) > 0 AS BIGINT), b))""")


def _counted(shingles: str) -> Column:
    """Shingles with their running number among equals: a bag as a set."""
    return F.expr(f"transform({shingles}, (h, i) -> struct(h, size(filter(slice({shingles}, 1, i + 1), x -> x = h)) AS nr))")


def _block(fp: str, b: int) -> Column:
    return (F.shiftrightunsigned(F.col(fp), 8 * b).bitwiseAND(F.lit(255))).cast("int")


_NEAR = sorted(m for m in range(256) if m.bit_count() <= 2)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, start (word
    of the best window), n_words, similarity, distance."""
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.coalesce("text", F.lit(""))).alias("words"))
             .where("size(words) > 0").withColumn("k", F.least(F.size("words"), F.lit(WORDS))))
    widths = [r["k"] for r in items.select("k").distinct().collect()]          # at most WORDS values
    found = None
    d = docs_of(docs).select("doc_id", words_of(F.col("text")).alias("words"))
    for k in sorted(widths):
        part = _search(d, items.where(F.col("k") == k).drop("k"), k, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, start long, n_words int, similarity double, distance int")
    return (found.groupBy("doc_id", "item_id")
            .agg(F.max_by(F.struct("start", "n_words", "similarity", "distance"),
                          F.struct(F.col("similarity"), -F.col("start"))).alias("best"))
            .select("doc_id", "item_id", "best.*"))


def _search(d: DataFrame, items: DataFrame, k: int, threshold: int) -> DataFrame:
    items = stage(items.withColumn("shingles", _shingles("words", k)).withColumn("n_words", F.size("words"))
                  .withColumn("item_fp", simhash("shingles")).select("item_id", "n_words", "shingles", "item_fp"), "items")
    size = items.agg(F.min(F.size("shingles")), F.sum(F.size("shingles"))).first()
    # Of n places at most n * apart can hold a shingle the item has not; every third place is enough if that is under a third.
    stride = 3 if size[0] >= 3 and threshold >= 67 else 1
    index = items.select("n_words", F.explode("shingles").alias("h")).distinct()
    if size[1] <= BROADCAST_ROWS:
        index = F.broadcast(index)
    same = ["doc_id", "h1", "h2", "n_words"]                       # repeated rows of one text are one
    places = (d.withColumn("h1", F.xxhash64("words")).withColumn("h2", F.hash("words"))
              .select("doc_id", "h1", "h2", "words", F.posexplode(_shingles("words", k, stride)).alias("nr", "h")))
    hits = (places.join(index, "h").groupBy(*same)
            .agg(F.first("words").alias("words"), F.sort_array(F.collect_set(F.col("nr") * stride)).alias("at")))
    n = F.col("n_words") - k + 1
    fewest = F.greatest(F.lit(1), F.floor(n / stride) - F.floor(n * (100 - threshold) / (100 + threshold))).cast("int")
    last = F.size("words") - F.col("n_words")

    def starting(i: Column) -> Column:
        """Starts of all windows whose first shared place is number ``i`` and that hold ``fewest`` of them."""
        low = F.greatest(F.lit(0), F.coalesce(F.get("at", i - 1) + 1, F.lit(0)), F.get("at", i + fewest - 1) - n + 1)
        high = F.least(F.get("at", i), last)
        return F.when(F.get("at", i + fewest - 1).isNotNull() & (low <= high), F.sequence(low, high)).otherwise(
            F.array().cast("array<int>"))
    starts = F.when(last <= 0, F.array(F.lit(0))).otherwise(
        F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - 1), starting)))
    windows = (hits.select("doc_id", "n_words", "words", F.explode(starts).alias("start"))
               .select("doc_id", F.col("start").cast("long").alias("start"), "n_words",
                       F.slice("words", F.col("start") + 1, F.col("n_words")).alias("window")))
    prints = stage(windows.withColumn("shingles", _shingles("window", k)).withColumn("fp", simhash("shingles"))
                   .withColumn("size", F.size("window")).drop("window"), "windows")
    blocks = F.array(*[F.struct(F.lit(b).alias("b"), _block("fp", b).alias("v")) for b in range(8)])
    near = F.array(*[F.lit(m) for m in _NEAR])

    def values(b: int) -> Column:
        return F.transform(near, lambda m: _block("item_fp", b).bitwiseXOR(m))
    own = F.array(*[F.struct(F.lit(b).alias("b"), values(b).alias("vs")) for b in range(8)])
    entries = (items.select("item_id", "n_words", "item_fp", F.explode(own).alias("o"))
               .select("item_id", "n_words", "item_fp", F.col("o.b").alias("b"), F.explode("o.vs").alias("v")))
    probes = prints.select("doc_id", "start", "n_words", "fp", F.explode(blocks).alias("p")).select(
        "doc_id", "start", "n_words", "fp", F.col("p.b").alias("b"), F.col("p.v").alias("v"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    close = (probes.join(entries, ["n_words", "b", "v"]).where(distance <= RADIUS)
             .select("doc_id", "start", "n_words", "fp", "item_id", distance.alias("distance")).distinct())
    theirs = items.select("item_id", _counted("shingles").alias("bag_i"))
    mine = prints.select("doc_id", "start", "n_words", "fp", "size", _counted("shingles").alias("bag_w"))
    both = F.size(F.array_intersect("bag_w", "bag_i"))
    return (close.withColumn("id", F.coalesce("doc_id", F.lit(-1)))
            .join(mine.withColumn("id", F.coalesce("doc_id", F.lit(-1))).drop("doc_id"), ["id", "start", "n_words", "fp"])
            .join(theirs, "item_id")
            .withColumn("similarity", both / F.size(F.array_union("bag_w", "bag_i")))
            .where(100 * both >= threshold * F.size(F.array_union("bag_w", "bag_i")))
            .select("doc_id", "item_id", "start", F.col("size").alias("n_words"), "similarity", "distance"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, all columns; a row
    without doc_id goes if any such row is contaminated."""
    bad = contaminated(docs, benchmark, threshold).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]), "left_anti")

"""Ranked lexical search with bag deduplication.

A document matters to a set of items only by how often it holds each of their
terms and by its length norm m.  Documents with equal counts and equal m form
a class; a class is scored once, and its members follow by ascending doc_id.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.llm.common import ship, stage

# Fixed values of the ranking: maximal runs of these bytes are terms (digits,
# letters and all beyond ASCII), A-Z in lower case; all else separates.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

BLOCK_TERMS = 200_000    # terms of a block of items, on average: what goes to every task
BLOCK_ITEMS = 4_096      # items of a block, on average
CELLS = 1 << 21          # scores that a task holds at a time


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _bags(vocabulary: dict):
    """Rows (doc_id, text) -> (doc_id, n, ids, tf): all terms counted, those
    of the vocabulary kept in ascending order."""
    def run(batches):
        for b in batches:
            n, ids, tf, at = [], [], [], [0]
            for text in b.column("text").cast(pa.binary()).to_pylist():
                words = terms(text)
                n.append(len(words))
                bag = Counter(map(vocabulary.get, words))
                bag.pop(None, None)
                order = sorted(bag)
                ids += order
                tf += [bag[t] for t in order]
                at.append(len(ids))
            offsets = pa.array(at, pa.int32())
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()),
                                   pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                                   pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))],
                                  names=["doc_id", "n", "ids", "tf"])
    return run


def _items(rows: list, vocabulary: dict) -> tuple[np.ndarray, np.ndarray]:
    """Items that hold a term, as (start of each term's items, items)."""
    of = [[] for _ in vocabulary]
    for i, r in enumerate(rows):
        for t in r["terms"]:
            of[vocabulary[bytes(t)]].append(i)
    return np.cumsum([0] + [len(x) for x in of]), np.array([i for x in of for i in x], np.int64)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def _scores(weights: np.ndarray, start: np.ndarray, members: np.ndarray, n_items: int, k: int):
    """Classes (ids, tf, m, docs) -> for every item the best k of this task
    (item, score, docs), by score and then by the class's first doc_id.

    No more than k classes of an item can hold one of its k best documents,
    for each class that goes before another has its first document before all
    of the other's.  All sums are below 2^53, so doubles hold them exactly.
    """
    def best(item, score, first, docs):
        order = np.lexsort((first, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < k]
        return item[place < k], score[order], first[order], [docs[i] for i in order]

    def run(batches):
        held = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), [])
        rows = max(1, CELLS // n_items)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                size, ids = _flat(b.column("ids"))
                _, tf = _flat(b.column("tf"))
                row, tf = np.repeat(np.arange(b.num_rows), size), tf.astype(np.int64)
                m = b.column("m").to_numpy().astype(np.int64)[row]
                part = weights[ids] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                score = np.zeros(b.num_rows * n_items)
                fan = start[ids + 1] - start[ids]
                step = 1 << 22                       # (term, item) pairs expanded at a time
                cuts = np.searchsorted(np.cumsum(fan), np.arange(step, fan.sum() + step, step))
                for lo, hi in zip([0, *cuts], [*cuts, len(fan)]):
                    f = fan[lo:hi]
                    if not f.sum():
                        continue
                    which = np.repeat(np.arange(lo, hi), f)
                    inside = np.arange(len(which)) - np.repeat(np.cumsum(f) - f, f)
                    item = members[start[ids[which]] + inside]
                    score += np.bincount(row[which] * n_items + item, weights=part[which].astype(float),
                                         minlength=len(score))
                docs = b.column("docs").to_pylist()
                first = np.array([d[0] for d in docs], np.int64)
                table = score.reshape(-1, n_items)
                if len(table) > k:                   # below the k-th best score of the batch nothing can win
                    bar = np.partition(table, len(table) - k, axis=0)[-k]
                else:
                    bar = np.zeros(n_items)
                r, i = np.nonzero((table >= bar) & (table > 0))
                held = best(np.concatenate([held[0], i]), np.concatenate([held[1], table[r, i]]),
                            np.concatenate([held[2], first[r]]), held[3] + [docs[x] for x in r])
        if len(held[0]):
            yield pa.record_batch([pa.array(held[0].astype(np.int32)), pa.array(held[1].astype(np.int64)),
                                   pa.array(held[3], pa.list_(pa.int64()))], names=["item", "score", "docs"])
    return run


def _block(spark: SparkSession, docs: DataFrame, rows: list, k: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
    bags = stage(docs.mapInArrow(_bags(vocabulary), "doc_id long, n long, ids array<int>, tf array<int>"), "bags")
    total = bags.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, length = int(total[0]), int(total[1])
    if not length:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    m = F.lit(10) + F.expr(f"(90 * n * {n_docs}L) div {length}L")
    held = bags.where("size(ids) > 0").withColumn("m", m).withColumn("bag", F.xxhash64("ids", "tf", "m"))
    df = {r["t"]: r["df"] for r in held.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
    start, members = _items(rows, vocabulary)
    # Equal hashes are verified by the values themselves; of a class the k smallest ids are enough.
    same = Window.partitionBy("bag", "m", "ids", "tf").orderBy("doc_id")
    few = held.where("doc_id is not null").withColumn("place", F.row_number().over(same)).where(F.col("place") <= k)
    classes = few.groupBy("bag", "m", "ids", "tf").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))
    best = classes.mapInArrow(_scores(weights, start, members, len(rows), k), "item int, score long, docs array<long>")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    top = (best.withColumn("doc_id", F.explode("docs")).withColumn("rank", rank).where(F.col("rank") <= k))
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of every item: (item_id, rank, doc_id, score).

    ``documents`` (doc_id, text), ``items`` (item_id, text); other columns are
    not read.  Null texts have no terms.  Every row of ``documents`` is a
    document, also if its id or text occurs again; one without doc_id counts
    in N, L and df and is not listed.  Rows of ``items`` with one item_id (null
    is one too) are one item with the terms of all.  An item without terms or
    without a matching document has no rows, as have all if no document holds
    a term.  Texts of any length are counted whole.

    Items are taken in blocks, as many as keep a block's vocabulary near
    BLOCK_TERMS and its items near BLOCK_ITEMS; a block's vocabulary, weights and
    item lists are all that is sent to the tasks.  Each document leaves the
    first task as counts of the vocabulary.  A class of any size sends at most
    ``k`` ids of each task on, a task at most ``k`` classes of each item.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def split(batches):
        for b in batches:
            yield pa.record_batch([b.column("item_id"), pa.array([list(set(terms(t))) for t in b.column("text").cast(pa.binary()).to_pylist()],
                                                                 pa.list_(pa.binary()))], names=["item_id", "terms"])

    parts = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = stage(parts.mapInArrow(split, "item_id long, terms array<binary>").select("item_id", F.explode("terms").alias("t"))
                  .distinct().groupBy("item_id").agg(F.collect_list("t").alias("terms")), "items")
    size = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, math.ceil(size[0] / BLOCK_ITEMS), math.ceil(size[1] / BLOCK_TERMS))
    out = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()      # of bounded size
        if rows:
            part = _block(spark, docs, rows, k)
            part = part if blocks == 1 else stage(part, "ranked")
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

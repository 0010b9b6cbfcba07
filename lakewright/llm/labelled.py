"""Labelled rows, a bounded sample of them, and folds by checksum of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; null without doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def training_labels(labels: DataFrame, label: str, train: Column) -> DataFrame:
    """All labelled ids (doc_id, y).  Ids with several label rows count once,
    with the mean label of at least one half as 1; null labels and ids are
    left out."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
            .where("doc_id is not null and y is not null").where(train)
            .groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")))


def training_sample(labels: DataFrame, label: str, train: Column, per_class: int) -> DataFrame:
    """At most ``per_class`` ids of ``training_labels`` of either class, chosen by hash."""
    y = training_labels(labels, label, train)
    halves = [y.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    return halves[0].unionByName(halves[1])


def with_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The documents of a sample; the sample is broadcast, its size is the
    bound given to ``training_sample``."""
    return docs.join(F.broadcast(sample), "doc_id")

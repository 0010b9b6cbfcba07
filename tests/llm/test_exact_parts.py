"""Screening in parts and slices, and the byte check, against brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakewright.llm import exact_dedup


@pytest.mark.parametrize("per_filter", [3, 40, 1 << 20])
@pytest.mark.parametrize("old", [1, 30, 400])
def test_a_batch_of_any_size_meets_a_snapshot_of_any_size(spark, monkeypatch, per_filter, old):
    monkeypatch.setattr(exact_dedup, "KEYS_PER_FILTER", per_filter)
    rows = [(i, f"text {i * i % 97} {i % 3}") for i in range(420)] + [(500, None), (501, ""), (502, " \t")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < old).collect()
    bare = {i: (t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}) for i, t in rows}
    size = Counter(bare.values())
    first = {}
    for i, t in sorted(rows, key=lambda r: (-len(r[1] or ""), r[0])):
        first.setdefault(bare[i], i)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got} == {
        i: (first[b], size[b], first[b] == i) for i, b in bare.items()}


def test_no_digest_screened_out_is_in_the_snapshot(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "KEYS_PER_FILTER", 16)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 200).alias("text"))
    rows = exact_dedup.stage(exact_dedup.digests(docs), "screen-test")
    snapshot = exact_dedup.Snapshot.build(rows.where("doc_id < 50"))
    new = exact_dedup._groups(rows.where("doc_id >= 40"))
    seen = {r["text_sha256"]: r["maybe"] for r in snapshot.screen(new).collect()}
    held = {r["text_sha256"] for r in snapshot.buckets.collect()}
    assert len(seen) == 200 and all(seen[h] for h in held)
    assert sum(seen.values()) <= len(held) + 8                      # one in 256 of the others


def test_byte_check_sees_different_texts_of_one_digest(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a ")], "doc_id long, text string")
    groups = spark.createDataFrame([("78" * 32, 3)], "text_sha256 string, group_size long")

    def same(docs, carry=(), with_bytes=False):
        return docs.select("doc_id", F.lit("78" * 32).alias("text_sha256"), F.encode(F.translate("text", " ", ""), "UTF-8").alias("norm"))
    monkeypatch.setattr(exact_dedup, "digests", same)
    assert [r["contents"] for r in exact_dedup.byte_conflicts(docs, groups).collect()] == [2]
    assert exact_dedup.byte_conflicts(docs.where("doc_id <> 2"), groups).collect() == []
    assert exact_dedup.byte_conflicts(docs, groups.where("group_size > 9")).collect() == []

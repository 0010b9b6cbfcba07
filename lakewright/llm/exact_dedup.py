"""Exact duplicates over immutable snapshots.

Texts are equal when identical after deleting the white space characters
``[\\x20\\x09-\\x0D]``.  A snapshot is a fixed set of digests; it carries one
static binary-fuse filter per part of the digest space (about 9 bits a
digest, built once, never changed).  Incoming digests are first grouped among
themselves, then screened by the filters: a digest that no filter holds is
certainly new; the positives join the snapshot's exact buckets, and their
bytes are compared.

Defined results: null text counts as empty; repeated rows are rows of their
own (the group size counts them); ties keep the most code points, then the
smallest doc_id (null last); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import docs_of, stage

WHITE_SPACE = b" \t\n\x0b\x0c\r"
KEYS_PER_FILTER = 1 << 20          # expected digests in one filter part


# --- binary fuse filter -----------------------------------------------------

def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class BinaryFuseFilter:
    """Three-wise binary fuse filter with one-byte fingerprints."""

    def __init__(self, seed: int, segment: int, span: int, table: np.ndarray):
        self.seed, self.segment, self.span, self.table = seed, segment, span, table

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys, self.seed)
        first = ((h >> np.uint64(32)) * np.uint64(self.span)) >> np.uint64(32)
        low = np.uint64(self.segment - 1)
        seg = np.uint64(self.segment)
        second = (first + seg) ^ ((h >> np.uint64(18)) & low)
        third = (first + seg + seg) ^ (h & low)
        return np.stack([first, second, third]).astype(np.int64), (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> "BinaryFuseFilter":
        keys = np.unique(np.asarray(keys, dtype=np.uint64))
        n = max(len(keys), 2)
        segment = 1 << max(2, min(18, int(np.log(n) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
        count = max(1, -(-int(n * factor) // segment) - 2)
        for seed in range(1, 200):
            f = cls(seed * 0x9E3779B97F4A7C15 & (2**64 - 1), segment, count * segment,
                    np.zeros((count + 2) * segment, np.uint8))
            if f._fill(keys):
                return f
        raise RuntimeError("no seed gives an acyclic filter")

    def _fill(self, keys: np.ndarray) -> bool:
        """Peel slots that one key holds, all of a round at a time, then
        assign the rounds backwards."""
        slots, prints = self._slots(keys)
        n = len(self.table)
        degree = np.bincount(slots.ravel(), minlength=n)
        owner = np.zeros(n, np.int64)                      # xor of the keys still in a slot
        for s in slots:
            np.bitwise_xor.at(owner, s, np.arange(len(keys)))
        alive = np.ones(len(keys), bool)
        rounds = []
        while alive.any():
            free = np.flatnonzero(degree == 1)
            if not len(free):
                return False
            who, first = np.unique(owner[free], return_index=True)
            at = free[first]
            rounds.append((who, at))
            alive[who] = False
            for s in slots[:, who]:
                np.subtract.at(degree, s, 1)
                np.bitwise_xor.at(owner, s, who)
        for who, at in reversed(rounds):
            a, b, c = self.table[slots[:, who]]
            self.table[at] = prints[who] ^ a ^ b ^ c       # its own slot is still 0
        return True

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self._slots(np.asarray(keys, dtype=np.uint64))
        a, b, c = self.table[slots]
        return (a ^ b ^ c) == prints


# --- digests ------------------------------------------------------------------

def normalised(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, WHITE_SPACE)


def digests(docs: DataFrame, carry: list[str] = (), with_bytes: bool = False) -> DataFrame:
    """``doc_id, n_chars, text_sha256, key`` (the digest's first 64 bits), the
    ``carry`` columns and, if asked for, the normalised bytes ``norm``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = part.column("text")
                norms = [normalised(t) for t in texts.to_pylist()]
                shas = [hashlib.sha256(x).digest() for x in norms]
                out = {"doc_id": part.column("doc_id"),
                       "n_chars": pc.cast(pc.utf8_length(texts), pa.int64()),
                       "text_sha256": pa.array([s.hex() for s in shas], pa.string()),
                       "key": pa.array([int.from_bytes(s[:8], "big", signed=True) for s in shas], pa.int64())}
                out |= {c: part.column(c) for c in carry}
                if with_bytes:
                    out["norm"] = pa.array(norms, pa.binary())
                yield pa.RecordBatch.from_pydict(out)
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.mapInArrow(run, "doc_id long, n_chars long, text_sha256 string, key long" + kinds
                           + (", norm binary" if with_bytes else ""))


def _best() -> Column:
    """The row that stays: most code points, smallest doc_id, null last."""
    turned = F.bitwise_not(F.col("doc_id"))                   # falls as doc_id rises, and has no sign to overflow
    return F.max(F.struct("n_chars", F.col("doc_id").isNotNull().alias("named"), turned.alias("turned_id")))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("text_sha256", "key").agg(F.count("*").alias("group_size"), _best().alias("best"))


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(parts)).cast("long").alias("part")


# --- snapshots ----------------------------------------------------------------

class Snapshot:
    """Buckets (one row per distinct digest, with the row that stays) and the
    filters over them.  Both are tables, so a snapshot is as large as it
    needs to be; nothing of it passes through the driver."""

    def __init__(self, buckets: DataFrame, filters: DataFrame, parts: int):
        self.buckets, self.filters, self.parts = buckets, filters, parts

    @classmethod
    def build(cls, rows: DataFrame) -> "Snapshot":
        buckets = stage(_groups(rows), "buckets")
        parts = 1 + buckets.count() // KEYS_PER_FILTER

        def fill(key, table):
            f = BinaryFuseFilter.build(table.column("key").to_numpy().astype(np.int64).view(np.uint64))
            return pa.table({"part": [key[0].as_py()], "seed": pa.array([f.seed - 2**63], pa.int64()),
                             "segment": [f.segment], "span": [f.span], "fingerprints": [f.table.tobytes()]})
        filters = buckets.select(_part(parts), "key").groupBy("part").applyInArrow(
            fill, "part long, seed long, segment long, span long, fingerprints binary")
        return cls(buckets, stage(filters, "filters"), parts)

    def screen(self, incoming: DataFrame) -> DataFrame:
        """``text_sha256, maybe``: false means certainly not in the snapshot.

        A part of the snapshot meets its incoming digests in slices of about
        KEYS_PER_FILTER, each with a copy of the part's filter, so that a new
        batch far larger than the snapshot is spread all the same."""
        slices = 1 + incoming.count() // (self.parts * KEYS_PER_FILTER)
        def look(key, rows, filters):
            keys = rows.column("key").to_numpy().astype(np.int64).view(np.uint64)
            hit = np.zeros(len(keys), bool)
            for f in filters.to_pylist():
                hit |= BinaryFuseFilter(f["seed"] + 2**63, f["segment"], f["span"],
                                        np.frombuffer(f["fingerprints"], np.uint8)).may_hold(keys)
            return pa.table({"text_sha256": rows.column("text_sha256"), "maybe": pa.array(hit)})
        copies = self.filters.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        return (incoming.select(_part(self.parts), F.pmod(F.hash("key"), F.lit(slices)).alias("slice"), "key", "text_sha256")
                .groupBy("part", "slice").cogroup(copies.groupBy("part", "slice"))
                .applyInArrow(look, "text_sha256 string, maybe boolean"))


def dedup_against(snapshot: Snapshot, incoming: DataFrame) -> DataFrame:
    """Groups over the snapshot and the incoming digests: ``text_sha256,
    group_size, best``.  Screened-out digests never meet the buckets."""
    new = stage(_groups(incoming), "incoming")
    maybe = stage(snapshot.screen(new), "screened").where("maybe").select("text_sha256")
    positives = new.join(maybe, "text_sha256", "left_semi")
    both = snapshot.buckets.unionByName(positives)
    fresh = new.join(maybe, "text_sha256", "left_anti").select("text_sha256", "group_size", "best")
    merged = both.groupBy("text_sha256").agg(F.sum("group_size").alias("group_size"), F.max("best").alias("best"))
    return merged.unionByName(fresh)


def byte_conflicts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests whose rows differ in bytes.  Spark groups by the normalised
    bytes themselves, so every row of a bucket is compared in full, copies
    within a task once, and no group meets in one task."""
    exact = digests(docs, with_bytes=True).select("text_sha256", "norm").distinct()
    return (exact.groupBy("text_sha256").agg(F.count("*").alias("contents")).where("contents > 1")
            .join(groups.where("group_size > 1"), "text_sha256", "left_semi"))


def exact_dedup(docs: DataFrame, snapshot_filter: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256, n_chars, row.

    ``snapshot_filter`` says which rows are the immutable snapshot; by default
    the lower half of the range of doc_id, the rest arrives as a new batch.
    Raises if two different texts share one SHA-256 digest.
    """
    d = docs_of(docs)
    if snapshot_filter is None:
        lo, hi = d.agg(F.min("doc_id"), F.max("doc_id")).first()
        snapshot_filter = F.col("doc_id") <= F.lit(((lo or 0) + (hi or 0)) // 2)
    d = d.withColumn("old", F.coalesce(snapshot_filter, F.lit(False)))
    rows = stage(digests(d, ["old"]).withColumn("row", F.monotonically_increasing_id()), "digests")
    snapshot = Snapshot.build(rows.where("old"))
    groups = stage(dedup_against(snapshot, rows.where("not old")), "groups")
    bad = byte_conflicts(d, groups).select("text_sha256").first()
    if bad is not None:
        raise ValueError(f"different texts share the digest {bad[0]}")
    keep = F.when(F.col("best.named"), F.bitwise_not(F.col("best.turned_id")))
    out = rows.join(groups, "text_sha256").withColumn("keep_id", keep)
    best = (out.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("best.n_chars")))
            .groupBy("text_sha256").agg(F.min("row").alias("keep_row")))
    return (out.join(best, "text_sha256")
            .select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                    "text_sha256", "n_chars", "row"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of equal texts one row, known
    by its doc_id, digest and length, whatever ids the others have.  Rows that
    agree in all three are repeats, and one of them stays."""
    kept = (exact_dedup(docs).where("kept")
            .select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest"), F.col("n_chars").alias("__length")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mine = (docs.withColumn("__sha", F.sha2(F.translate(text, " \t\n\x0b\x0c\r", ""), 256))
            .withColumn("__chars", F.length(text).cast("long")))
    same = ((mine["__sha"] == kept["__digest"]) & mine["doc_id"].cast("long").eqNullSafe(kept["__id"]) & (mine["__chars"] == kept["__length"]))
    return mine.join(kept, same, "left_semi").dropDuplicates(["__sha"]).drop("__sha", "__chars")

"""Mixture-controlled packing of token streams into fixed-length sequences.

Every source is a queue of documents.  A window is WINDOW tokens of the packed
stream; each source has a quota of tokens in every window, its target
proportion.  What a quota can't give (fractions of a token) is carried as a
deficit into the next window, so that after any number of windows a source is
less than one token from its target.  Quotas are a closed form of the window
number and of the queues' totals: which window takes which part of a document
is known for all partitions at once, and deficits cross partitions without a
chain of tasks.  Inside a window the queues are served by deficit round robin
in packets of whole document parts.

Sequences are consecutive SEQUENCE tokens of the packed stream, so that
only the end of the stream is short; it is cut into sequences whose lengths
are powers of two, which need no padding.

Defined results: null text is empty and gives the end id alone; a null source
is a queue of its own; repeated rows are packed as rows of their own; without
rows the result is empty.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import docs_of, stage
from lakewright.llm.tokens import encoder

SEQUENCE = 1024
WINDOW = 1 << 20
QUANTUM = 1 << 14                  # tokens a round of all queues sends


class Schedule:
    """Cumulative quotas of the queues, as exact fractions.

    Targets hold while a queue has tokens; when one runs dry the others share
    its place in proportion, so that no token is dropped.  ``targets`` None:
    each queue's share of all tokens, with which all end together.
    """

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None = None, window: int = WINDOW):
        self.totals = {s: n for s, n in sorted(totals.items()) if n > 0}
        self.window, self.tokens = window, sum(self.totals.values())
        weight = {s: Fraction(n) if targets is None else Fraction(str(targets.get(s, 0)))
                  for s, n in self.totals.items()}
        self.steps: list[tuple[Fraction, dict[str, Fraction]]] = [(Fraction(0), dict.fromkeys(self.totals, Fraction(0)))]
        left = set(self.totals)
        while left:
            active = {s for s in left if weight[s] > 0} or left
            w = {s: weight[s] if weight[s] > 0 else Fraction(self.totals[s]) for s in active}
            at, done = self.steps[-1]
            all_w = sum(w.values())
            length = min((self.totals[s] - done[s]) * all_w / w[s] for s in active)
            done = {s: done[s] + (length * w[s] / all_w if s in active else 0) for s in done}
            self.steps.append((at + length, done))
            left -= {s for s in active if done[s] == self.totals[s]}

    @property
    def windows(self) -> int:
        return -(-self.tokens // self.window)

    def quota(self, source: str, k: int) -> int:
        """Tokens of ``source`` in the first ``k`` windows."""
        g = Fraction(k * self.window)
        for (a, qa), (b, qb) in zip(self.steps, self.steps[1:]):
            if g < b:
                return int(qa[source] + (qb[source] - qa[source]) * (g - a) / (b - a))
        return self.totals[source]

    def start(self, k: int) -> int:
        """Position of window ``k`` in the packed stream."""
        return sum(self.quota(s, k) for s in self.totals)

    def window_of(self, source: str, x: int) -> int:
        """The window that takes token ``x`` of a queue."""
        lo, hi = 0, self.windows
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.quota(source, mid + 1) > x else (mid + 1, hi)
        return lo


def round_robin(queues: dict[str, list[tuple]], shares: dict[str, float], quantum: int = QUANTUM) -> list[tuple]:
    """Deficit round robin: each round credits a queue with its share of the
    quantum, and it sends parts from its head while the credit covers them.
    A part is ``(row, start, length)``."""
    order, heads = [], dict.fromkeys(queues, 0)
    credit = dict.fromkeys(queues, 0.0)
    waiting = sorted(queues)
    while waiting:
        # Rounds in which no head is covered send nothing: they are taken at once.
        need = min((queues[s][heads[s]][2] - credit[s]) / max(1e-9, shares[s] * quantum) for s in waiting)
        rounds = max(1, int(np.ceil(need)))
        for s in waiting:
            credit[s] += rounds * shares[s] * quantum
            q = queues[s]
            while heads[s] < len(q) and q[heads[s]][2] <= credit[s] + 1e-6:
                credit[s] -= q[heads[s]][2]
                order.append(q[heads[s]])
                heads[s] += 1
        waiting = [s for s in waiting if heads[s] < len(queues[s])]
    return order


def tail_cuts(tokens: int, length: int = SEQUENCE) -> list[int]:
    """Starts of the sequences after the last full one, and the end: the rest
    in falling powers of two."""
    at = tokens - tokens % length
    cuts = [at]
    for bit in range(length.bit_length() - 1, -1, -1):
        if (tokens - cuts[0]) >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    return cuts


def _encode(docs: DataFrame, tokenizer: str, space_joined: bool, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, space_joined)
        end = np.array([end_id], enc.dtype).tobytes()
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [x + end for x in enc.encode(part.column("text").to_pylist())]
                n = len(ids)
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(range(row, row + n), pa.int64()), "doc_id": part.column("doc_id"),
                    "source": part.column("source"), "ids": pa.array(ids, pa.binary()),
                    "n": pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64())})
                row += n
    return docs.mapInArrow(run, "row long, doc_id long, source string, ids binary, n long")


def _queue_parts(rows: DataFrame, schedule: Schedule, first: dict) -> DataFrame:
    """Parts of documents by window: row, source, window, start, length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, k, end = {}, {}, {}
        for b in batches:
            out = defaultdict(list)
            for pid, row, source, n in zip(*(b.column(c).to_pylist() for c in ("pid", "row", "source", "n"))):
                key = (pid, source)
                if key not in at:
                    at[key] = first[key]
                    k[key] = schedule.window_of(source, at[key])
                    end[key] = schedule.quota(source, k[key] + 1)
                start = 0
                while start < n:
                    while end[key] <= at[key]:
                        k[key] += 1
                        end[key] = schedule.quota(source, k[key] + 1)
                    length = min(n - start, end[key] - at[key])
                    for c, v in zip(("row", "source", "window", "start", "length", "place"),
                                    (row, source, k[key], start, length, at[key])):
                        out[c].append(v)
                    start += length
                    at[key] += length
            if out:
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.string() if c == "source" else pa.int64())
                                                  for c, v in out.items()})
    return rows.mapInArrow(run, "row long, source string, window long, start long, length long, place long")


def _fill_windows(parts: DataFrame, schedule: Schedule) -> DataFrame:
    """Position of every part in the packed stream (a window holds at most
    WINDOW parts, as no part is empty)."""
    def fill(pdf):
        k = int(pdf["window"].iloc[0])
        pdf = pdf.sort_values(["source", "place"], kind="stable")
        queues = {s: list(zip(g["row"], g["start"], g["length"])) for s, g in pdf.groupby("source", sort=True)}
        total = sum(pdf["length"])
        order = round_robin(queues, {s: sum(x[2] for x in q) / total for s, q in queues.items()})
        row, start, length = (np.array(x, np.int64) for x in zip(*order))
        return pd.DataFrame({"row": row, "start": start, "length": length,
                             "place": schedule.start(k) + np.cumsum(length) - length})
    return parts.groupBy("window").applyInPandas(fill, "row long, start long, length long, place long")


def _pieces(tokens: DataFrame, width: int, total: int, length: int) -> DataFrame:
    """Cuts every part at the borders of sequences."""
    cuts = tail_cuts(total, length)
    base = cuts[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = defaultdict(list)
            for d, n, ids, parts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids", "parts"))):
                raw = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                for p in parts:
                    start, left, place = p["start"], p["length"], p["place"]
                    while left:
                        if place < base:
                            seq, lo, hi = place // length, place // length * length, (place // length + 1) * length
                        else:
                            j = int(np.searchsorted(cuts, place, "right")) - 1
                            seq, lo, hi = base // length + j, cuts[j], cuts[j + 1]
                        take = min(left, hi - place)
                        for c, v in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"),
                                        (d, start, take, zlib.crc32(raw[4 * start:4 * (start + take)]), n, seq, place - lo)):
                            out[c].append(v)
                        start, left, place = start + take, left - take, place + take
            if out:
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})
    return tokens.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                  "sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, space_joined: bool, end_id: int, targets: dict[str, float] | None = None,
         length: int = SEQUENCE, window: int = WINDOW) -> DataFrame:
    """Packed pieces of all documents: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    d = docs_of(docs, "source").withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    tokens = stage(_encode(d, tokenizer, space_joined, end_id), "tokens")
    width = encoder(tokenizer, space_joined).dtype.itemsize
    # Queue order: source, then doc_id.  The order is written down before it
    # is used, as a range partitioning drawn twice may have other borders.
    queue = stage(tokens.select("row", "doc_id", "source", "n")
                  .repartitionByRange("source", "doc_id", "row").sortWithinPartitions("source", "doc_id", "row")
                  .withColumn("pid", F.spark_partition_id())
                  .withColumn("nr", F.monotonically_increasing_id()), "queue")
    sums = queue.groupBy("source", "pid").agg(F.sum("n").alias("n")).collect()   # partitions + sources rows
    totals, first = defaultdict(int), {}
    for r in sorted(sums, key=lambda r: (r["source"], r["pid"])):
        first[(r["pid"], r["source"])] = totals[r["source"]]
        totals[r["source"]] += r["n"]
    schedule = Schedule(totals, targets, window)
    ordered = queue.repartition("pid").sortWithinPartitions("pid", "nr")
    parts = _fill_windows(_queue_parts(ordered, schedule, first), schedule)
    by_row = parts.groupBy("row").agg(F.collect_list(F.struct("start", "length", "place")).alias("parts"))
    return _pieces(tokens.join(by_row, "row"), width, schedule.tokens, length)

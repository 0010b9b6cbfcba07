"""Token shards as wavelet matrices.

A shard holds the tokens of consecutive documents (ascending doc_id) as one
row of a Parquet file: a packed bit-plane per bit of the vocabulary, the
number of zeros of each plane, and rank samples.  From it ``access``,
``rank``, ``count`` and ``select`` (occurrence lookup) are answered without
decoding the shard; ``decode`` restores all tokens.  The written files answer
``tokens_at``, ``token_counts`` and ``occurrences`` as Spark jobs over shards,
by token positions in the whole corpus.

Defined results: null text is empty and yields the end id alone; null doc_id
comes first; rows with equal doc_id follow one another, ordered by their ids;
an empty table gives no file row and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import docs_of, stage
from lakewright.llm.tokens import encoder

SHARD_TOKENS = 1 << 21
RANGE_DOCS = 8192
MAX_RANGES = 10_000
BLOCK = 512                         # bits between two rank samples
MAX_ASKED = 10_000                  # tokens of one count or lookup
SHARD_SCHEMA = ("range_id int, seq int, n_tokens long, levels int, doc_ids array<long>, doc_starts binary, "
                "zeros array<long>, planes array<binary>, ranks array<binary>")


class WaveletMatrix:
    """Planes from the highest bit down; each level moves its zeros first."""

    def __init__(self, n: int, planes: list[bytes], zeros: list[int], ranks: list[bytes]):
        self.n, self.levels, self.zeros = n, len(planes), zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> "WaveletMatrix":
        planes, zeros, ranks = [], [], []
        cur = ids
        for level in range(levels - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(bool)
            packed = np.packbits(bit)
            padded = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[:len(packed)] = packed
            ones = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(1)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes())
            planes.append(packed.tobytes())
            zeros.append(int(len(cur) - bit.sum()))
            cur = np.concatenate([cur[~bit], cur[bit]])
        return cls(len(ids), planes, zeros, ranks)

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // BLOCK
        start = block * BLOCK // 8
        whole = int(np.bitwise_count(self.planes[level][start:i // 8]).sum())
        tail = int(self.planes[level][i // 8]) >> (8 - i % 8) if i % 8 else 0
        return int(self.ranks[level][block]) + whole + tail.bit_count()

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.levels):
            b = self._bit(level, i)
            value = value << 1 | b
            i = self.zeros[level] + self._rank1(level, i) if b else i - self._rank1(level, i)
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` among the first ``i`` end up."""
        lo, hi = 0, i
        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = ((self.zeros[level] + a, self.zeros[level] + b)
                      if token >> (self.levels - 1 - level) & 1 else (lo - a, hi - b))
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` among the first ``i`` tokens."""
        if token >> self.levels:
            return 0
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th occurrence (from 0) of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0)[0] + k
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            want = i - self.zeros[level] if one else i
            lo, hi = 0, self.n                       # smallest prefix with want + 1 such bits
            while lo < hi:
                mid = (lo + hi) // 2
                ones = self._rank1(level, mid + 1)
                if (ones if one else mid + 1 - ones) <= want:
                    lo = mid + 1
                else:
                    hi = mid
            i = lo
        return i

    def _ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        """``_rank1`` of many positions at once."""
        plane = np.append(self.planes[level], np.uint8(0))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(plane), dtype=np.int64)])
        return ones[at >> 3] + np.bitwise_count(plane[at >> 3].astype(np.int64) >> (8 - (at & 7)))

    def access_many(self, at: np.ndarray) -> np.ndarray:
        """The tokens at the positions ``at``."""
        at = np.asarray(at, np.int64)
        value = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            bit = self.planes[level][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            ones = self._ones_before(level, at)
            value = value << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return value

    def find(self, token: int) -> np.ndarray:
        """All positions of ``token``, ascending: its range in the last plane's
        order is followed up, a plane at a time."""
        if token < 0 or token >> self.levels:
            return np.empty(0, np.int64)
        at = np.arange(*self._range(token, self.n), dtype=np.int64)
        for level in range(self.levels - 1, -1, -1):
            if not len(at):
                break
            one = token >> (self.levels - 1 - level) & 1
            bits = np.unpackbits(self.planes[level], count=self.n) == one
            at = np.flatnonzero(bits)[at - (self.zeros[level] if one else 0)]
        return at

    def decode(self) -> np.ndarray:
        """All tokens, undoing the moves from the lowest plane up."""
        out = np.zeros(self.n, np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n).astype(bool)
            z, back = self.zeros[level], np.empty_like(out)
            back[~bit] = out[:z]
            back[bit] = out[z:] | np.uint32(1 << (self.levels - 1 - level))
            out = back
        return out


def _encode(docs: DataFrame, tokenizer: str, space_joined: bool, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, space_joined)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [x + end for x in enc.encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_pydict({"range_id": part.column("range_id"), "doc_id": part.column("doc_id"),
                                                  "ids": pa.array(ids, pa.binary())})
    return docs.select("range_id", "doc_id", "text").mapInArrow(run, "range_id int, doc_id long, ids binary")


def _shards(tokens: DataFrame, width: int, levels: int) -> DataFrame:
    """Cuts each range's documents, in order, into shards of SHARD_TOKENS."""
    def pack(range_id, seq, held) -> pa.RecordBatch:
        lengths = [len(x) // width for _, x in held]
        ids = np.frombuffer(b"".join(x for _, x in held), f"<u{width}")
        w = WaveletMatrix.build(ids, levels)
        return pa.RecordBatch.from_pydict({
            "range_id": pa.array([range_id], pa.int32()), "seq": pa.array([seq], pa.int32()),
            "n_tokens": pa.array([len(ids)], pa.int64()), "levels": pa.array([levels], pa.int32()),
            "doc_ids": pa.array([[d for d, _ in held]], pa.list_(pa.int64())),
            "doc_starts": pa.array([np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes()], pa.binary()),
            "zeros": pa.array([w.zeros], pa.list_(pa.int64())),
            "planes": pa.array([[p.tobytes() for p in w.planes]], pa.list_(pa.binary())),
            "ranks": pa.array([[r.tobytes() for r in w.ranks]], pa.list_(pa.binary()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, held, size = None, 0, [], 0
        for b in batches:
            for r, d, x in zip(*(b.column(c).to_pylist() for c in ("range_id", "doc_id", "ids"))):
                if held and (r != now or size >= SHARD_TOKENS):
                    yield pack(now, seq, held)
                    seq, held, size = seq + 1, [], 0
                if r != now:
                    now, seq = r, 0
                held.append((d, x))
                size += len(x) // width
        if held:
            yield pack(now, seq, held)
    return tokens.mapInArrow(run, SHARD_SCHEMA)


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, space_joined: bool, end_id: int) -> None:
    """Encode every text and write the shard files to ``path``."""
    d = docs_of(docs)
    n, lo, hi = d.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    ranges = max(1, min(MAX_RANGES, n // RANGE_DOCS))
    # Borders by rank, not by value, so that gaps in doc_id don't matter.
    borders = d.where("doc_id is not null").agg(F.percentile_approx(
        "doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges)).first()[0] if n and lo is not None else []
    borders = sorted({int(x) for x in borders or []})[:ranges - 1]
    where = F.lit(0)
    if borders:
        marks = F.array(*[F.lit(x) for x in borders])
        where = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(marks, lambda m: m < F.col("doc_id"))))
    enc = encoder(tokenizer, space_joined)
    levels = max(1, (max(enc.tokenizer.get_vocab_size() - 1, end_id)).bit_length())
    tokens = _encode(d.withColumn("range_id", where.cast("int")), tokenizer, space_joined, end_id)
    placed = tokens.repartition(ranges, "range_id").sortWithinPartitions("range_id", "doc_id", "ids")
    _shards(placed, enc.dtype.itemsize, levels).write.option("compression", "zstd").parquet(path)


def read_token_shards(spark, path: str) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start, n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    files = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = {c: b.column(c)[i].as_py() for c in b.schema.names}
                ids = WaveletMatrix(s["n_tokens"], s["planes"], s["zeros"], s["ranks"]).decode().astype("<u4")
                cuts = np.frombuffer(s["doc_starts"], "<i8")
                raw = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_pydict({
                    "range_id": pa.array([s["range_id"]] * len(s["doc_ids"]), pa.int32()),
                    "seq": pa.array([s["seq"]] * len(s["doc_ids"]), pa.int32()),
                    "doc_id": pa.array(s["doc_ids"], pa.int64()), "at": pa.array(cuts[:-1], pa.int64()),
                    "n_tokens": pa.array(np.diff(cuts), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(cuts, cuts[1:])], pa.int64())})
    docs = files.mapInArrow(run, "range_id int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(shard_starts(files), ["range_id", "seq"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _matrix(b: pa.RecordBatch, i: int) -> WaveletMatrix:
    return WaveletMatrix(*(b.column(c)[i].as_py() for c in ("n_tokens", "planes", "zeros", "ranks")))


def _asked(tokens: list[int]) -> list[int]:
    if len(tokens) > MAX_ASKED:
        raise ValueError(f"at most {MAX_ASKED} tokens at a time, not {len(tokens)}")
    return sorted({int(t) for t in tokens})


def token_counts(spark, path: str, tokens: list[int]) -> DataFrame:
    """Occurrences of each of ``tokens`` (at most MAX_ASKED; 0 for absent ones) in
    all shards: token, n.  Shards are ranked, not decoded."""
    asked = _asked(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                w = _matrix(b, i)
                yield pa.RecordBatch.from_pydict({"token": pa.array(asked, pa.int64()),
                                                  "n": pa.array([w.count(t) if t >= 0 else 0 for t in asked], pa.int64())})
    files = spark.read.schema(SHARD_SCHEMA).parquet(path).select("n_tokens", "planes", "zeros", "ranks")
    none = spark.createDataFrame([(t, 0) for t in asked], "token long, n long")
    return files.mapInArrow(run, "token long, n long").unionByName(none).groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark, path: str, tokens: list[int]) -> DataFrame:
    """Every place of each of ``tokens`` (at most MAX_ASKED): token, doc_id, at (in
    its document), position (in the corpus).  A task holds one shard and one
    token's places in it."""
    asked = _asked(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                w, ids = _matrix(b, i), b.column("doc_ids")[i].values
                cuts = np.frombuffer(b.column("doc_starts")[i].as_py(), "<i8")
                for t in asked:
                    at = w.find(t)
                    doc = np.searchsorted(cuts, at, "right") - 1
                    yield pa.RecordBatch.from_pydict({
                        "range_id": pa.array(np.full(len(at), b.column("range_id")[i].as_py(), np.int32)),
                        "seq": pa.array(np.full(len(at), b.column("seq")[i].as_py(), np.int32)),
                        "token": pa.array(np.full(len(at), t, np.int64)), "doc_id": ids.take(pa.array(doc)),
                        "at": pa.array(at - cuts[doc]), "inside": pa.array(at)})
    files = spark.read.schema(SHARD_SCHEMA).parquet(path)
    found = files.select("range_id", "seq", "n_tokens", "doc_ids", "doc_starts", "planes", "zeros", "ranks").mapInArrow(
        run, "range_id int, seq int, token long, doc_id long, at long, inside long")
    return found.join(shard_starts(files), ["range_id", "seq"]).select(
        "token", "doc_id", "at", (F.col("base") + F.col("inside")).alias("position"))


def tokens_at(spark, path: str, positions: DataFrame) -> DataFrame:
    """The token at each distinct ``position`` (in the corpus) of ``positions``:
    position, token; null or outside positions give no row.  Positions meet
    their shard by the blocks of SHARD_TOKENS it covers; a shard has at most as
    many distinct positions as tokens."""
    files = spark.read.schema(SHARD_SCHEMA).parquet(path)
    block = F.lit(SHARD_TOKENS)
    spans = (shard_starts(files).join(files.select("range_id", "seq", "n_tokens"), ["range_id", "seq"])
             .withColumn("block", F.explode(F.sequence(F.floor(F.col("base") / block), F.floor((F.col("base") + F.col("n_tokens") - 1) / block)))))
    asked = positions.select(F.col("position").cast("long").alias("position")).where("position >= 0").distinct()
    placed = (asked.withColumn("block", F.floor(F.col("position") / block)).join(spans, "block")
              .where((F.col("position") >= F.col("base")) & (F.col("position") < F.col("base") + F.col("n_tokens")))
              .select("range_id", "seq", "position", (F.col("position") - F.col("base")).alias("inside")))

    def look(key, wanted: pa.Table, shards: pa.Table) -> pa.Table:
        if not wanted.num_rows:
            return pa.table({"position": pa.array([], pa.int64()), "token": pa.array([], pa.int64())})
        w = _matrix(shards.combine_chunks().to_batches()[0], 0)
        return pa.table({"position": wanted.column("position"), "token": pa.array(w.access_many(wanted.column("inside").to_numpy()))})
    return (placed.groupBy("range_id", "seq").cogroup(
        files.select(F.col("range_id").alias("shard_range"), F.col("seq").alias("shard_seq"), "n_tokens", "planes", "zeros", "ranks")
        .groupBy("shard_range", "shard_seq"))
        .applyInArrow(look, "position long, token long"))


def shard_starts(files: DataFrame) -> DataFrame:
    """First token position of every shard: ranges are summed on their own
    (at most MAX_RANGES rows), shards within their range."""
    from pyspark.sql import Window
    sizes = files.select("range_id", "seq", "n_tokens")
    before = Window.partitionBy("range_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("range_id").agg(F.sum("n_tokens").alias("total"))
    ahead = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("range_id", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("range_base"))
    local = sizes.select("range_id", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("local"))
    return local.join(bases, "range_id").select("range_id", "seq", (F.col("range_base") + F.col("local")).alias("base"))

"""Nearest vectors by inner product, by counting collisions of projections.

Every shard of the vectors holds one sorted array for each random projection.
A query opens a window around its own place in every array and widens all of
them together (virtual rehashing: no array is built anew for a wider radius).
A vector met in enough windows is verified on its original components.  The
windows stop growing once they are so wide that a vector nearer than the k-th
verified one is met in enough of them with high probability.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.llm.common import ship, stage

SHARD = 8192            # vectors of one shard, on average: about 10 MB of arrays at 64 components
GROUP = 16_384          # queries that one task holds at a time, on average
PROJECTIONS = 64        # sorted arrays of a shard, at least (see ``frames``)
WIDEST = 128            # and at most
START, GROWTH = 0.4, 1.5
SHARE = 0.75            # of the windows must hold a vector for it to be verified
# A vector at distance D lies in a window of half-width h with probability
# 2 * phi(h / D) - 1.  At h = REACH * D that is 0.79; SHARE of it is reached by
# three of four vectors at that very distance, and by most that are nearer.
REACH = 1.25


def frames(dim: int, seed: int = 7) -> np.ndarray:
    """Projections of vectors of ``dim`` components and their norm's
    complement: orthogonal directions, as many frames as make PROJECTIONS;
    scaled so that a difference of length D projects to about N(0, D)."""
    d = dim + 1
    draw = np.random.default_rng([seed, d])
    parts = [np.linalg.qr(draw.standard_normal((d, d)))[0] for _ in range(max(1, math.ceil(PROJECTIONS / d)))]
    return (np.concatenate(parts, axis=1)[:, :WIDEST] * math.sqrt(d)).astype(np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector, dim): vectors that take part.  Left out: null ids,
    null, empty and zero vectors, vectors with a null, NaN or infinite
    component.  Of several vectors of one id the smallest counts."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.col("embedding").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    v = v.where("vec_id is not null and size(vector) > 0").where(~bad).where(F.exists("vector", lambda x: x != 0))
    return v.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def _widest(dim: int) -> float:
    """Half a window that holds every place: unit vectors lie within
    sqrt(dim + 1) of nought in every projection."""
    return 2.0 * math.sqrt(dim + 1) + 1.0


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _norms(m: np.ndarray) -> np.ndarray:
    top = np.abs(m).max(axis=1, keepdims=True)
    return (top * np.sqrt(((m / top) ** 2).sum(axis=1, keepdims=True)))[:, 0]


def _lengths(batches):
    for b in batches:
        column = b.column("vector")
        starts, x = column.offsets.to_numpy()[:-1], column.values.to_numpy(zero_copy_only=False)
        size, starts = np.diff(column.offsets.to_numpy()), starts - starts[:1]
        x = x[column.offsets[0].as_py():column.offsets[-1].as_py()]
        norm = np.empty(0)
        if len(size):                                   # no vector is empty or zero
            top = np.maximum.reduceat(np.abs(x), starts)
            norm = top * np.sqrt(np.add.reduceat((x / np.repeat(top, size)) ** 2, starts))
        yield pa.record_batch([b.column("dim"), b.column("asked"), pa.array(norm)], names=["dim", "asked", "longest"])


_INDEX = "dim int, shard long, ids binary, vectors binary, places binary, members binary"


def _build(directions: dict, longest: dict):
    def build(table: pa.Table) -> pa.Table:
        dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
        ids, v = table["vec_id"].to_numpy(), _matrix(table["vector"], dim)
        unit = v / longest[dim]
        rest = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1, keepdims=True)))
        places = (np.concatenate([unit, rest], axis=1) @ directions[dim]).T
        members = np.argsort(places, axis=1, kind="stable")
        line = np.take_along_axis(places, members, axis=1) + np.arange(len(places))[:, None] * 4 * _widest(dim)
        row = [[x.tobytes()] for x in (ids.astype(np.int64), v, line, members.astype(np.int32))]
        return pa.table([pa.array([dim], pa.int32()), pa.array([shard], pa.int64()),
                         *[pa.array(x, pa.binary()) for x in row]],
                        names=["dim", "shard", "ids", "vectors", "places", "members"])
    return build


def _verified(ids, v, line, members, query, own: int, at, longest: float, near: int) -> np.ndarray:
    """Rows of a shard whose collisions reach the threshold, once the windows
    around ``at`` are wide enough for the ``near`` nearest of them.  ``line`` holds
    the sorted arrays one behind the other, each moved to a range of its own,
    so that the ends of all windows are found by one search."""
    n, m = len(ids), len(at)
    need, widest = math.ceil(SHARE * m), _widest(v.shape[1])
    size = float(_norms(query[None, :])[0]) * longest
    centre = at + np.arange(m) * 4 * widest
    lo = hi = np.searchsorted(line, centre).tolist()
    counts, found, best = np.zeros(n, np.int64), np.zeros(n, bool), np.empty(0)
    half = START
    while True:
        left, right = lo, hi
        lo = np.searchsorted(line, centre - half).tolist()
        hi = np.searchsorted(line, centre + half, "right").tolist()
        ring = [members[a:b] for a, b in zip(lo + right, left + hi) if a < b]
        if ring:
            counts += np.bincount(np.concatenate(ring), minlength=n)
            new = np.flatnonzero((counts >= need) & ~found)
            found[new] = True
            best = np.concatenate([best, v[new[ids[new] != own]] @ query])
        wanted = widest
        if len(best) >= near:
            best = np.partition(best, len(best) - near)[-near:]
            wanted = min(widest, REACH * math.sqrt(max(0.0, 2.0 - 2.0 * best[0] / size)))
        if half >= wanted:
            break
        half = min(half * GROWTH, wanted)
    return np.flatnonzero(found & (ids != own))


def expected(k: int, part: float) -> int:
    """How many of the k nearest a shard with ``part`` of the vectors holds:
    two standard deviations and one above the mean.  It steers how wide the
    windows open, and does not limit what a shard returns."""
    return min(k, math.ceil(k * part + 2.0 * math.sqrt(k * part) + 1.0))


def _search(directions: dict, longest: dict, totals: dict, k: int):
    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if index.num_rows and queries.num_rows:
            dim = index["dim"][0].as_py()
            part = lambda name, kind: np.frombuffer(index[name][0].as_py(), kind)
            ids, v = part("ids", np.int64), part("vectors", np.float64).reshape(-1, dim)
            line, members = part("places", np.float64), part("members", np.int32).astype(np.int64)
            q_ids, q = queries["vec_id"].to_numpy(), _matrix(queries["vector"], dim)
            at = (q / _norms(q)[:, None]) @ directions[dim][:dim]
            near, hits = expected(k, len(ids) / totals[dim]), []
            for i in range(len(q)):
                rows = _verified(ids, v, line, members, q[i], q_ids[i], at[i], longest[dim], near)
                if len(rows) > k:                   # those that may be among the k, with room for rounding
                    s = v[rows] @ q[i]
                    rows = rows[s >= np.partition(s, len(s) - k)[-k] - 1e-9 * np.abs(s).max()]
                hits.append(rows)
            of, rows = np.repeat(np.arange(len(q)), [len(x) for x in hits]), np.concatenate(hits)
            score = np.zeros(len(rows))
            for j in range(dim):                    # one order of additions for all: equal vectors score equal
                score += v[rows, j] * q[of, j]
            best = np.lexsort((ids[rows], -score, of))
            of, rows, score = of[best], rows[best], score[best]
            first = np.searchsorted(of, np.arange(len(q)))
            top = np.arange(len(of)) - first[of] < k
            out = [q_ids[of[top]], ids[rows[top]], score[top]]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                        names=["query_id", "vec_id", "score"])
    return search


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``vectors`` (vec_id, embedding) -> (query_id, rank, vec_id, score).

    Queries are the vectors whose id is divisible by ``every``, candidates all
    vectors of the same length but the query's own; the k with the largest
    inner product come back, ties by the smaller vec_id.  Candidates are found
    with high probability, not surely: see REACH.  All are listed where there
    are at most k.  See ``usable`` for the vectors that take part; an empty
    table gives no rows, other columns are not read.

    A shard's index and a group of queries meet in one task, both of bounded
    size; ids are unique there, so no shard or group is hot, and equal vectors
    are spread over the shards by their ids.  Only a query's k best of every
    shard are shuffled.  The work is queries times vectors in the worst case,
    as of any search for the nearest among vectors without near neighbours.
    """
    spark = vectors.sparkSession
    ship(spark)
    used = stage(usable(vectors), "vectors")
    asked = F.pmod("vec_id", F.lit(every)) == 0
    sizes = (used.select("dim", asked.alias("asked"), "vector").mapInArrow(_lengths, "dim int, asked boolean, longest double")
             .groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asked").alias("q"), F.max("longest").alias("longest"))
             .collect())                                                            # one row per vector length
    directions = {r["dim"]: frames(r["dim"]) for r in sizes}
    longest, totals = {r["dim"]: r["longest"] for r in sizes}, {r["dim"]: r["n"] for r in sizes}
    pieces = lambda per, count: F.coalesce(*[F.when(F.col("dim") == r["dim"], F.lit(max(1, math.ceil(r[count] / per))).cast("long"))
                                             for r in sizes], F.lit(1).cast("long"))
    shards, groups = pieces(SHARD, "n"), pieces(GROUP, "q")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(math.ceil(r["n"] / SHARD) for r in sizes)))
    held = used.withColumn("shard", F.pmod(F.xxhash64("vec_id"), shards))
    index = stage(held.repartition(parts, "dim", "shard").groupBy("dim", "shard")
                  .applyInArrow(_build(directions, longest), _INDEX), "index")
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)))
    right = (used.where(asked).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), groups))
             .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1))))
    found = (left.groupBy("dim", "shard", "part").cogroup(right.groupBy("dim", "shard", "part"))
             .applyInArrow(_search(directions, longest, totals, k), "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

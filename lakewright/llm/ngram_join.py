"""N-gram Jaccard join and its components.

A document's set holds its distinct word shingles (64-bit hashes).  Two
documents link when ``100 * |A & B| >= threshold * |A | B|``.  Every link is
found:

1. Documents with one and the same set become one class.
2. Prefix filter under one global order of shingles (frequent last): linked
   sets share a shingle among their first ``n - ceil(t * n) + 1``.  A shingle's
   classes, sorted by size, form a tile; a size band (ratio at least t) slides
   over it.
3. In a tile, classes of one size stand in an order of the tile's own.  A
   class's neighbours in its first FIRST shared tiles are a few pairs for each
   class; those that verify are contracted to components.  Then rounds follow
   over tiles that hold several components: each class outside a tile's largest
   component names its best partners in other components, more in each round,
   and verified ones are contracted.  A tile is done when no list was cut, so
   that every pair has been tested or lies in one component; the last tile ends
   the rounds.  So a large group of near copies costs a few pairs for each copy
   and no quadratic list.  Counts of shingles by 64 hash classes bound a pair's
   overlap inside the tile, before it is written, and rank the partners.
4. A candidate's hashed bitmaps bound its overlap from above,
   ``|A & B| <= |A| - bits(A and not B)``; the rest is decided by
   the exact intersection of the sorted arrays.

The order of shingles comes from a hashed count table of fixed size over all
documents; a collision in it can only move a shingle in the order.

Defined results: null, empty and blank texts have the empty set and link with
nothing; rows with one doc_id are one node; a row without doc_id has a set,
but component_id null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.common import docs_of, stage
from lakewright.llm.components import components

COUNT_BUCKETS = 1 << 18
CHUNKS = 16
SUB_BATCH_BYTES = 1 << 20
SCREEN_BITS = 1 << 23
FIRST = 8                           # shared prefix places that give neighbours
PARTNERS = 4                        # a class's partners in a tile, first round
MORE = 16                           # times as many in each further round
CLASSES = 64

_R = np.random.default_rng(20240229)
_BYTE = _R.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_WORD = _R.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = np.empty(0, np.uint64)


def _factors(n: int) -> np.ndarray:
    """A multiplier for each place in a word.  They follow no geometric series:
    powers modulo 2^64 give words of a regular pattern the same sum."""
    global _FACTORS
    if len(_FACTORS) < n:
        _FACTORS = _mix(np.arange(1, max(n, 2 * len(_FACTORS), 256) + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    return _FACTORS


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a batch; ``data``
    holds the texts' UTF-8 bytes, text ``i`` from ``offsets[i]`` on."""
    n = len(data)
    empty = np.empty(0, np.uint64)
    low = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    letter = ~((low == 32) | ((low >= 9) & (low <= 13)))
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before[edge] = False
    after[edge - 1] = False
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    if not len(starts):
        return [empty] * (len(offsets) - 1)
    size = ends - starts
    factors = _factors(int(size.max()))
    heads = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(heads, size)
    h = _mix(np.add.reduceat(_BYTE[low[letter]] * factors[place], heads) + size.astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    whole = len(h) - words + 1
    if whole > 0:
        s = h[:whole] * _WORD[0]
        for j in range(1, words):
            s = s + h[j:whole + j] * _WORD[j]
        s = _mix(s)
    out = []
    for a, z in zip(first, first[1:]):
        if z - a >= words:
            out.append(np.unique(s[a:z - words + 1]))
        elif z > a:
            short = (h[a:z] * _WORD[32:32 + z - a]).sum(dtype=np.uint64) + np.uint64(z - a)
            out.append(_mix(np.array([short], np.uint64)))
        else:
            out.append(empty)
    return out


def _batches(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) of pieces of a batch with about SUB_BATCH_BYTES."""
    text = batch.column("text").cast(pa.large_binary())
    if len(text) == 0:
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SUB_BATCH_BYTES, "right")) - 1)
        to = min(to, len(text))
        yield at, shingle_sets(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], words)
        at = to


def _key(s: np.ndarray) -> int:
    return int(s.sum(dtype=np.uint64).view(np.int64))


def _summaries(docs: DataFrame, words: int) -> DataFrame:
    """One row per document (doc_id, n, k1, k2: size and hash of its set), and
    per task the chunks of the count table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNT_BUCKETS, np.int64)
        for b in batches:
            for at, sets in _batches(b, words):
                every = np.concatenate(sets)
                counts += np.bincount((every >> np.uint64(46)).astype(np.int64), minlength=COUNT_BUCKETS)
                k1 = [_key(s) for s in sets]
                k2 = [_key(_mix(s ^ np.uint64(_BASE))) for s in sets]
                n = len(sets)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").slice(at, n), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()),
                    "chunk": pa.nulls(n, pa.int32()), "counts": pa.nulls(n, pa.binary())})
        parts = counts.astype("<u4").reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_pydict({
            **{c: pa.nulls(CHUNKS, pa.int64()) for c in ("doc_id", "n", "k1", "k2")},
            "chunk": pa.array(range(CHUNKS), pa.int32()), "counts": pa.array([p.tobytes() for p in parts], pa.binary())})
    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, chunk int, counts binary")


def _levels(chunks: DataFrame) -> np.ndarray:
    """The count table as one byte a bucket: half octaves above the mean."""
    def add(key, table):
        total = sum(np.frombuffer(x, "<u4").astype(np.uint64) for x in table.column("counts").to_pylist())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})
    rows = chunks.groupBy("chunk").applyInArrow(add, "chunk int, total binary").collect()   # 2 MB in all
    total = np.zeros((CHUNKS, COUNT_BUCKETS // CHUNKS))
    for r in rows:
        total[r["chunk"]] = np.frombuffer(r["total"], np.uint64)
    total = total.ravel()
    return np.clip(2 * np.log2((total + 1) / (total.mean() + 1)), 0, 255).astype(np.uint8)


def bitmap(s: np.ndarray) -> bytes:
    """Hashed bitmap, about two bits a shingle, a power of two wide."""
    bits = 1 << max(6, int(2 * len(s) - 1).bit_length())
    hit = np.zeros(bits, bool)
    hit[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(hit, bitorder="little").tobytes()


def class_counts(s: np.ndarray) -> bytes:
    """Shingles by hash class, one byte each; empty if one doesn't fit."""
    counts = np.bincount((s >> np.uint64(40)).astype(np.int64) % CLASSES, minlength=CLASSES)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def overlap_bound(a: bytes, na: int, b: bytes, nb: int) -> int:
    """Upper bound of the overlap; the wider bitmap is folded first."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    w = min(len(x), len(y))
    x, y = np.bitwise_or.reduce(x.reshape(-1, w)), np.bitwise_or.reduce(y.reshape(-1, w))
    return min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))


def _signatures(docs: DataFrame, words: int, threshold: int, levels: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, sets in _batches(b, words):
                prefixes = []
                for s in sets:
                    keep = len(s) - -(-threshold * len(s) // 100) + 1 if len(s) else 0
                    level = levels[(s >> np.uint64(46)).astype(np.int64)]
                    prefixes.append(s[np.argsort(level, kind="stable")[:keep]].view(np.int64))
                yield pa.RecordBatch.from_pydict({
                    "id": b.column("doc_id").slice(at, len(sets)),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "k1": pa.array([_key(s) for s in sets], pa.int64()),
                    "prefix": pa.array(prefixes, pa.list_(pa.int64())),
                    "bits": pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary()),
                    "counts": pa.array([class_counts(s) for s in sets], pa.binary())})
    return docs.mapInArrow(run, "id long, n long, k1 long, prefix array<long>, bits binary, counts binary")


def _tiles(postings: DataFrame, threshold: int) -> DataFrame:
    """Tiles of at least two classes: tok, nr, n, id, and ``prev``, the class
    before it in the tile if it is within the size band.  Classes of one size
    stand in a hashed order that differs from tile to tile.  ``postings`` (tok,
    nr, n, id) stream by in order; no tile is ever held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(tok, nr, n, i, prev, has_prev, keep) -> pa.RecordBatch:
            near = has_prev[keep]
            return pa.RecordBatch.from_pydict({"tok": pa.array(tok[keep]), "nr": pa.array(nr[keep]), "n": pa.array(n[keep]),
                                               "id": pa.array(i[keep]), "prev": pa.array(prev[keep], mask=~near)})

        last = None                                   # the latest row: its successor decides
        for b in batches:
            if not b.num_rows:
                continue
            tok, nr, n, i = (b.column(c).to_numpy() for c in ("tok", "nr", "n", "id"))
            if last is not None:
                tok, nr, n, i = (np.concatenate([x, y]) for x, y in zip(last[:4], (tok, nr, n, i)))
            same = tok[1:] == tok[:-1]
            first = last[4] if last is not None else np.zeros(1, bool)
            in_tile = np.concatenate([first, same])
            prev = np.concatenate([last[5] if last is not None else i[:1], i[:-1]])
            near = same & (100 * n[:-1] >= threshold * n[1:])
            band = np.concatenate([last[6] if last is not None else first, near])
            keep = in_tile | np.concatenate([same, [False]])
            keep[-1] = False
            yield rows(tok, nr, n, i, prev, band, keep)
            last = (tok[-1:], nr[-1:], n[-1:], i[-1:], in_tile[-1:], prev[-1:], band[-1:])
        if last is not None and last[4][0]:
            yield rows(*last[:4], last[5], last[6], np.ones(1, bool))
    return (postings.repartition("tok").sortWithinPartitions("tok", "n", F.xxhash64("id", "tok"), "id")
            .select("tok", "nr", "n", "id").mapInArrow(run, "tok long, nr int, n long, id long, prev long"))


def _pairs(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _neighbours(tiles: DataFrame) -> DataFrame:
    """Pairs of neighbours in a class's first FIRST tiles."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("nr", "tok"))
    return (tiles.where("prev is not null").select("id", "nr", "tok", "prev").withColumn("place", place)
            .where(F.col("place") <= FIRST).select(*_pairs("id", "prev")).distinct())


def _tile_cross_pairs(n, ids, comp, counts, threshold: int, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of one tile (sorted by n) whose components differ, that lie in the
    size band and pass the class counts' bound; of each member the ``most``
    best, and whether any had more.  Only members outside the tile's largest
    component look for partners."""
    known, size = np.unique(comp, return_counts=True)
    main = known[np.argmax(size)]
    wide = np.array([not c for c in counts])          # counts beyond a byte: bounded by the other's size, if at all
    m = np.frombuffer(b"".join(c or b"\xff" * CLASSES for c in counts), np.uint8).reshape(-1, CLASSES)
    a, b, cut = [], [], False
    for r in np.flatnonzero(comp != main):
        lo = np.searchsorted(n, -(-threshold * n[r] // 100))
        hi = np.searchsorted(n, 100 * n[r] // threshold, "right")
        spare = (np.minimum(m[lo:hi], m[r]).sum(1, dtype=np.int64)
                 + (-threshold * (n[r] + n[lo:hi]) // (100 + threshold)))       # bound less the overlap needed
        if wide[r]:
            spare[wide[lo:hi]] = np.iinfo(np.int64).max
        other = np.flatnonzero((spare >= 0) & (comp[lo:hi] != comp[r]))
        if len(other) > most:
            cut = True
            other = other[np.lexsort((ids[lo + other], -spare[other]))[:most]]
        a.append(np.full(len(other), ids[r]))
        b.append(ids[lo + other])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b]), cut


def _cross_pairs(postings: DataFrame, threshold: int, most: int) -> DataFrame:
    """Candidates (a, b) of tiles that hold several components, and a row with
    ``tok`` for each tile where a list was cut.  ``postings``: tok, n, id, comp,
    counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(tok, tile) -> pa.RecordBatch:
            n, ids, comp = (np.concatenate([t[j] for t in tile]) for j in range(3))
            a, b, cut = _tile_cross_pairs(n, ids, comp, [c for t in tile for c in t[3]], threshold, most)
            more = [None] * cut
            return pa.RecordBatch.from_pydict({"a": pa.array([*a.tolist(), *more], pa.int64()),
                                               "b": pa.array([*b.tolist(), *more], pa.int64()),
                                               "tok": pa.array([None] * len(a) + [int(tok)] * cut, pa.int64())})

        tok, tile = None, []
        for batch in batches:
            toks, n, ids, comp = (batch.column(c).to_numpy() for c in ("tok", "n", "id", "comp"))
            counts = batch.column("counts").to_pylist()
            cuts = [0, *(np.flatnonzero(toks[1:] != toks[:-1]) + 1), len(toks)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if tile and toks[lo] != tok:
                        yield out(tok, tile)
                        tile = []
                    tok = toks[lo]
                    tile.append((n[lo:hi], ids[lo:hi], comp[lo:hi], counts[lo:hi]))
        if tile:
            yield out(tok, tile)
    return (postings.repartition("tok").sortWithinPartitions("tok", "n", "id").select("tok", "n", "id", "comp", "counts")
            .mapInArrow(run, "a long, b long, tok long").select(*_pairs("a", "b"), "tok").distinct())


def _of_several(placed: DataFrame) -> DataFrame:
    """The tiles that hold several components, as a staged table."""
    placed = placed.repartition("tok")
    mixed = placed.groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("tok")
    return stage(placed.join(mixed, "tok", "left_semi"), "mixed")


def _contract(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``found`` (id, component_id) after further edges (a, b).  What is linked
    already counts as one node, so that few edges are left."""
    one = lambda c: found.select(F.col("id").alias(c), F.col("component_id").alias(f"c{c}"))
    rest = (edges.join(one("a"), "a", "left").join(one("b"), "b", "left")
            .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    second = components(rest).select(F.col("id").alias("first"), F.col("component_id").alias("second"))
    moved = (found.withColumnRenamed("component_id", "first").join(second, "first", "left")
             .select("id", F.coalesce("second", "first").alias("component_id")))
    new = (second.join(found.select(F.col("id").alias("first")), "first", "left_anti")
           .select(F.col("first").alias("id"), F.col("second").alias("component_id")))
    return stage(moved.unionByName(new), "found")


def _screen_words(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (SCREEN_BITS) over the hashed ids."""
    at = F.pmod(F.xxhash64("id"), F.lit(SCREEN_BITS)) + 1
    rows = (ids.select(F.bitmap_bucket_number(at).alias("nr"), F.bitmap_bit_position(at).alias("pos"))
            .groupBy("nr").agg(F.bitmap_construct_agg("pos").alias("bits")).collect())      # 1 MB in all
    out = np.zeros((SCREEN_BITS // 32768 + 2, 4096), np.uint8)
    for r in rows:
        out[r["nr"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def _verify(docs: DataFrame, pairs: DataFrame, sigs: DataFrame, words: int, threshold: int) -> DataFrame:
    """The candidates that link: bitmap bound, then the exact intersection."""
    def need(na: int, nb: int) -> int:
        return -(-threshold * (na + nb) // (100 + threshold))

    def bound(batches):
        for b in batches:
            cols = [b.column(x).to_pylist() for x in ("a", "b", "na", "nb", "bits_a", "bits_b")]
            keep = [(x, y) for x, y, na, nb, p, q in zip(*cols)
                    if 100 * min(na, nb) >= threshold * max(na, nb) and overlap_bound(p, na, q, nb) >= need(na, nb)]
            yield pa.RecordBatch.from_pydict({"a": pa.array([k[0] for k in keep], pa.int64()),
                                              "b": pa.array([k[1] for k in keep], pa.int64())})

    left = sigs.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    right = sigs.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    likely = stage(pairs.join(left, "a").join(right, "b").mapInArrow(bound, "a long, b long"), "likely")
    ids = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()
    screen = _screen_words(ids)

    def arrays(batches):
        for b in batches:
            at = b.column("at").to_numpy() - 1
            hit = screen[at // 32768 + 1, at % 32768 // 8] >> (at % 8).astype(np.uint8) & 1
            some = b.filter(pa.array(hit.astype(bool)))
            for first, sets in _batches(some, words):
                yield pa.RecordBatch.from_pydict({"id": some.column("id").slice(first, len(sets)),
                                                  "set": pa.array([s.tobytes() for s in sets], pa.binary())})

    place = (F.pmod(F.xxhash64("doc_id"), F.lit(SCREEN_BITS)) + 1).alias("at")
    sets = docs.select(F.col("doc_id").alias("id"), place, "text").mapInArrow(arrays, "id long, set binary")

    def exact(batches):
        for b in batches:
            a, z = [], []
            for i, j, p, q in zip(*(b.column(x).to_pylist() for x in ("a", "b", "set_a", "set_b"))):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= threshold * (len(x) + len(y) - both):
                    a.append(i)
                    z.append(j)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(z, pa.int64())})
    return stage(likely.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
                 .join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
                 .mapInArrow(exact, "a long, b long").distinct(), "links")


def ngram_components(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the
    smallest doc_id reachable by links)."""
    d = docs_of(docs)
    summary = stage(_summaries(d, words), "summaries")
    rows = summary.where("chunk is null").select("doc_id", "n", "k1", "k2")
    classes = stage(rows.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2")
                    .agg(F.min("doc_id").alias("id")), "classes")
    levels = _levels(summary.where("chunk is not null"))
    sigs = stage(_signatures(d, words, threshold, levels)
                 .join(classes.select("id", "n", "k1"), ["id", "n", "k1"], "left_semi"), "signatures")
    tiles = stage(_tiles(sigs.select("id", "n", F.posexplode("prefix").alias("nr", "tok")), threshold), "tiles")
    near = _verify(d, _neighbours(tiles), sigs, words, threshold)
    found = stage(components(near.unionByName(_shared_ids(rows, classes))), "found")
    left, most = tiles.select("tok", "n", "id"), PARTNERS
    while True:
        mixed = _of_several(left.join(found, "id", "left")
                            .select("tok", "n", "id", F.coalesce("component_id", "id").alias("comp")))
        far = stage(_cross_pairs(mixed.join(sigs.select("id", "n", "counts"), ["id", "n"]), threshold, most), "far")
        links = _verify(d, far.where("tok is null").select("a", "b"), sigs, words, threshold)
        if not links.isEmpty():
            found = _contract(found, links)
        cut = far.where("tok is not null").select("tok")
        if cut.isEmpty():
            break
        left, most = mixed.select("tok", "n", "id").join(cut, "tok", "left_semi"), most * MORE
    groups = (rows.where("n > 0 and doc_id is not null").join(classes, ["n", "k1", "k2"]).select("doc_id", "id").distinct()
              .join(found, "id", "left")
              .groupBy(F.col("doc_id").alias("node")).agg(F.min(F.coalesce("component_id", "id")).alias("component_id")))
    return (rows.join(groups, rows["doc_id"] == groups["node"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id")))


def _shared_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between classes that rows of one doc_id tie together."""
    own = rows.where("n > 0 and doc_id is not null").join(classes, ["n", "k1", "k2"])
    spread = own.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("doc_id", "a")
    return own.join(spread, "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def keep_one_per_component(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` that no linked document with a smaller doc_id
    precedes, all columns; rows without doc_id stay."""
    drop = (ngram_components(docs, words, threshold).where("component_id <> doc_id")
            .select(F.col("doc_id").alias("__drop")))
    return docs.join(drop, docs["doc_id"] == drop["__drop"], "left_anti")

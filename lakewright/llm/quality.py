"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text (shares of
character classes, repetition of words and lines, word lengths).  Preference
pairs set a document labelled 1 against one labelled 0; the weights minimise
the logistic loss of the pairs' feature differences.  The cut between kept
and rejected is the quantile of the training strengths that the share of
label 0 gives; the score is the logistic function of the distance to it, so
0.5 is the cut.

Fitted on every labelled document and every pair of them: a Newton step needs
sums over the pairs, which follow from sums over the documents of either class
by bins of strength (a pair is weighted by its bins' mean strengths and by what
their spread adds, to the second order), so a step is one job over the
documents' features.  The cut is exact.  Null and empty
texts have the features of the empty text and get its score; a repeated id
trains once; repeated rows are scored alike; without labels of both classes
every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import docs_of, stage
from lakewright.llm.labelled import fold, training_labels

RIDGE = 1e-4
BIN = 1 / 8                         # of strength, for the weights of pairs
CUT_BINS = 4_096
_CLASSES = [range(65, 91), range(97, 123), range(48, 58), range(128, 256), b" ", b"\n", b".", b",", b"!", b"|", b"#",
            b"%", b"&", b"*", b"$", b"?-:;'\"()/", b"=<>@+_~^`\\[]{}"]
_CLASS_OF = np.full(256, len(_CLASSES))
for _i, _c in enumerate(_CLASSES):
    _CLASS_OF[list(_c)] = _i


def features(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    shares = np.bincount(_CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=len(_CLASSES) + 1) / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w, ln = max(1, len(words)), max(1, len(lines))
    distinct = len(set(words)) / w if words else 1.0
    lines_once = len(set(lines)) / ln if lines else 1.0
    mean = len(b"".join(words)) / w
    return np.concatenate([np.sqrt(shares), [
        distinct, max(0.0, 1 - distinct * min(1, w / 50)), lines_once, mean / 10, np.log1p(n) / 10, np.log1p(w) / 10,
        float(w < 5), float(w < 20), np.log1p(w / ln) / 5, max(map(len, words), default=0) / n]])


def _feature_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "x": pa.array(x, pa.list_(pa.float64()))})
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _strengths(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (x * weights).sum(1)                               # the same for a row in whatever batch


def _class_sums(rows: DataFrame, weights: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By class, per occupied bin of strength: how many documents, and the
    sums of their features and of the features' products."""
    schema = "y int, bin long, n long, x array<double>, xx array<double>"

    def table(keys: np.ndarray, n: list, x: list, xx: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "y": pa.array(keys % 2, pa.int32()), "bin": pa.array(keys // 2, pa.int64()), "n": pa.array(n, pa.int64()),
            "x": pa.array(x, pa.list_(pa.float64())), "xx": pa.array(xx, pa.list_(pa.float64()))})

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in filter(lambda b: b.num_rows, batches):
            x = _matrix(b.column("x"), b.num_rows)
            key = np.floor(_strengths(x, weights) / BIN).astype(np.int64) * 2 + b.column("y").to_numpy(zero_copy_only=False)
            order = np.argsort(key, kind="stable")
            found, first = np.unique(key[order], return_index=True)
            for k, part in zip(found.tolist(), np.split(x[order], first[1:])):
                new = [len(part), part.sum(0), (part.T @ part).ravel()]
                sums[k] = [a + c for a, c in zip(sums[k], new)] if k in sums else new
        if sums:
            yield table(np.array(list(sums), np.int64), *zip(*sums.values()))

    def add(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, xx = (_matrix(t.column(c).chunk(0), t.num_rows).sum(0) for c in ("x", "xx"))
        key = np.array([2 * t.column("bin")[0].as_py() + t.column("y")[0].as_py()], np.int64)
        return pa.Table.from_batches([table(key, [sum(t.column("n").to_pylist())], [x], [xx])])
    bins = rows.mapInArrow(tally, schema).groupBy("y", "bin").applyInArrow(add, schema).orderBy("y", "bin").collect()
    out = {}
    for y in (0, 1):
        own = [r for r in bins if r["y"] == y]
        x = np.array([r["x"] for r in own])
        out[y] = (np.array([r["n"] for r in own], float), x,
                  np.array([r["xx"] for r in own]).reshape(len(own), *(x.shape[1:] * 2)))
    return out


def _pair_sums(good: tuple, bad: tuple, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean logistic loss of all pairs, its falling gradient (both to the
    second order of strengths within a bin) and its second derivatives."""
    (n, x, xx), (m, z, zz) = good, bad
    (s, among_x), (t, among_z) = (((u @ weights) / c, uu @ weights - u * ((u @ weights) / c)[:, None]) for c, u, uu in (good, bad))
    spread = ((among_x @ weights) / n)[:, None] + ((among_z @ weights) / m)[None, :]
    d = s[:, None] - t[None, :]
    miss = 1 / (1 + np.exp(np.clip(d, -30, 30)))              # chance of the pair's other order
    k = miss * (1 - miss)
    loss = n @ (np.logaddexp(0, -d) + k * spread / 2) @ m
    even = miss + k * (1 - 2 * miss) * spread / 2
    slope = x.T @ (even @ m) - among_x.T @ (k @ m) - z.T @ (n @ even) - among_z.T @ (n @ k)
    cross = x.T @ k @ z
    curve = np.tensordot(k @ m, xx, 1) + np.tensordot(n @ k, zz, 1) - cross - cross.T
    pairs = n.sum() * m.sum()
    return loss / pairs, slope / pairs, curve / pairs


def _cut(strengths: DataFrame, below: int) -> float:
    """Midway between the ``below``-th smallest strength and the next one,
    by bins of ever smaller width."""
    s = F.col("s")
    lo, hi = strengths.agg(F.min(s), F.max(s)).first()
    before = 0
    while lo < hi:
        bins = (strengths.where(s.between(lo, hi)).groupBy(F.floor((s - lo) / (hi - lo) * CUT_BINS).alias("bin"))
                .agg(F.count("*").alias("n"), F.min(s).alias("least"), F.max(s).alias("most")).orderBy("bin").collect())
        upto = before + np.cumsum([r["n"] for r in bins])
        i = int(np.searchsorted(upto, below))
        if upto[i] == below:
            return (bins[i]["most"] + bins[i + 1]["least"]) / 2
        before, lo, hi = int(upto[i] - bins[i]["n"]), bins[i]["least"], bins[i]["most"]
    return lo


class BradleyTerry:
    """Strength ``x @ weights``; ``cut`` separates the rejected share."""

    def __init__(self, weights: np.ndarray, cut: float):
        self.weights, self.cut = weights, cut

    @classmethod
    def fit(cls, rows: DataFrame) -> "BradleyTerry":
        """Of a staged table: y, x."""
        n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if len(n) < 2:
            return cls(np.empty(0), 0.0)
        weights = np.zeros(len(rows.first()["x"]))
        step, least, at = np.zeros(len(weights)), np.inf, weights
        for _ in range(25):                                   # Newton steps of the pairs' logistic loss
            sums = _class_sums(rows, weights)
            loss, slope, curve = _pair_sums(sums[1], sums[0], weights)
            loss += RIDGE / 2 * weights @ weights
            if loss > least + 1e-6:
                step = step / 2
            else:
                least, at = loss, weights
                step = np.linalg.solve(curve + RIDGE * np.eye(len(weights)), slope - RIDGE * weights)
            weights = at + step
            if np.abs(step).max() < 1e-3:                     # the error is of the order of the step's square
                break

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in filter(lambda b: b.num_rows, batches):
                yield pa.RecordBatch.from_pydict({"s": pa.array(_strengths(_matrix(b.column("x"), b.num_rows), weights))})
        return cls(weights, _cut(stage(rows.select("x").mapInArrow(run, "s double"), "strengths"), n[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(_strengths(x, self.weights) - self.cut, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> BradleyTerry:
    train = fold(modulus) != held
    # Features travel to the labels, not texts; of a repeated id's rows one trains.
    x = _feature_rows(docs_of(docs).where(train)).groupBy("doc_id").agg(F.min("x").alias("x"))
    return BradleyTerry.fit(stage(x.join(training_labels(labels, "quality", train), "doc_id").select("y", "x"), "features"))


def score_quality(docs: DataFrame, model: BradleyTerry, modulus: int = 3, held: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = np.array([features(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"),
                                                  "score": pa.array(model.score(x), pa.float64())})
    return (docs_of(docs).mapInArrow(run, "doc_id long, score double")
            .select("doc_id", F.coalesce(fold(modulus) == held, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def drop_low_quality(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """The rows of ``docs`` that score at least 0.5, all columns; the score is
    computed beside the row, so no join is needed."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def keep(texts):
        import pandas as pd
        x = np.array([features(t or "") for t in texts])
        return pd.Series(model.score(x) >= 0.5)
    from lakewright.llm.common import ship
    ship(docs.sparkSession)
    return docs.where(keep(F.col("text").cast("string")))

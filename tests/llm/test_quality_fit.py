"""The quality model and its cut against all pairs of all labelled documents."""

import numpy as np
from pyspark.sql import functions as F

from lakewright.llm import quality

GOOD = ["The harvest was good, and the village kept a third of it for the winter.",
        "A letter from the coast tells of rain, of ships and of a long wait.",
        "In 1904 the bridge was finished; the road came ten years later.", "Short but fine.",
        "We walked home. Nobody spoke. The lamps were lit already.\nThen it snowed."]
BAD = ["BUY NOW!!! $$$ buy buy buy buy", "click | here | click | here | click", "###", "www www www 1 2 3 4 5 6 7 8 9",
       "The lamps were lit already. Nobody spoke, and we walked home.", "&nbsp;&nbsp;&nbsp; @@@ %%% ***"]
EACH = 7_000                                # documents of either class: more than any bound there was


def all_pairs(x, z, n, m):
    """Weights over every pair of distinct texts, counted as often as they occur."""
    d = (x[:, None] - z[None]).reshape(-1, x.shape[1])
    share = np.outer(n, m).ravel() / n.sum() / m.sum()
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(d @ w))
        curve = (d * (share * p * (1 - p))[:, None]).T @ d + quality.RIDGE * np.eye(len(w))
        w = w + np.linalg.solve(curve, d.T @ (share * p) - quality.RIDGE * w)
    return w


def test_fit_takes_every_labelled_document_and_pair(spark):
    n = np.array([EACH - 10, 4, 3, 2, 1])
    m = np.array([1, EACH - 15, 2, 3, 4, 5])
    texts = np.repeat(GOOD + BAD, np.concatenate([n, m]))
    y = np.repeat([1, 0], [EACH, EACH])
    rows = spark.createDataFrame([(i, str(t), int(v)) for i, (t, v) in enumerate(zip(texts, y))], "doc_id long, text string, quality int")
    rows = rows.repartition(4).cache()
    model = quality.fit_quality(rows.select("doc_id", "text"), rows.select("doc_id", "quality"), modulus=1, held=1)
    x, z = (np.array([quality.features(t) for t in half]) for half in (GOOD, BAD))
    want = all_pairs(x, z, n, m)
    gap = lambda w: (x @ w)[:, None] - (z @ w)[None]
    assert np.abs(gap(model.weights) - gap(want)).max() < 2e-3, np.abs(gap(model.weights) - gap(want)).max()
    strengths = np.sort(np.repeat(np.concatenate([x, z]) @ model.weights, np.concatenate([n, m])))
    assert abs(model.cut - (strengths[EACH - 1] + strengths[EACH]) / 2) < 1e-9


def test_cut_is_exact_among_ties_and_outliers(spark):
    rng = np.random.default_rng(3)
    s = np.concatenate([rng.normal(size=5_000), np.full(3_000, 0.25), [-1e9, 1e9], 0.25 + np.arange(500) * 1e-13])
    rows = spark.createDataFrame([(float(v),) for v in s], "s double").repartition(3).cache()
    s = np.sort(s)
    at = int(np.searchsorted(s, 0.25))
    for k in (1, 2, at, at + 1, at + 2_999, at + 3_000, at + 3_100, 4_000, len(s) - 1):
        assert quality._cut(rows, k) == (s[k - 1] + s[k]) / 2, k
    assert quality._cut(rows.select(F.lit(1.5).alias("s")), 7) == 1.5

"""Access, counts and lookups from written shard files, against the ids themselves."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from lakewright.llm import wavelet
from lakewright.llm.queries import tokenizer_path

WORD = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Files of several ranges and shards, and all ids with their documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "the cat"), (-5, None), (10**9, "the " * 9000), (10**9 + 1, "")], "doc_id long, text string")
    docs = docs.unionByName(extra)
    path = str(tmp_path_factory.mktemp("shards") / "files")
    keep = wavelet.SHARD_TOKENS, wavelet.RANGE_DOCS
    wavelet.SHARD_TOKENS, wavelet.RANGE_DOCS = 4096, 40
    try:
        wavelet.write_token_shards(docs, path, tokenizer_path(WORD), False, 2)
    finally:
        wavelet.SHARD_TOKENS, wavelet.RANGE_DOCS = keep
    tk = Tokenizer.from_file(tokenizer_path(WORD))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    all_ids, owner, inside = [], [], []
    for i, t in rows:
        ids = [*tk.encode(t, add_special_tokens=False).ids, 2]
        all_ids += ids
        owner += [i] * len(ids)
        inside += range(len(ids))
    return path, np.array(all_ids), owner, inside


def some_tokens(ids):
    values, n = np.unique(ids, return_counts=True)
    order = np.argsort(n)
    return sorted({2, 48_999, *(int(values[i]) for i in (*order[:3], *order[-4:]))})


def test_files_hold_several_shards(spark, corpus):
    files = spark.read.schema(wavelet.SHARD_SCHEMA).parquet(corpus[0])
    assert files.select("range_id").distinct().count() > 1 and files.where("seq > 0").count() > 0


def test_counts(spark, corpus):
    path, ids, *_ = corpus
    asked = some_tokens(ids)
    got = {r["token"]: r["n"] for r in wavelet.token_counts(spark, path, [*asked, asked[0], 10**7, -1]).collect()}
    assert got == {**{t: int((ids == t).sum()) for t in asked}, 10**7: 0, -1: 0}
    assert wavelet.token_counts(spark, path, []).collect() == []
    with pytest.raises(ValueError):
        wavelet.token_counts(spark, path, list(range(wavelet.MAX_ASKED + 1)))


def test_occurrences(spark, corpus):
    path, ids, owner, inside = corpus
    asked = some_tokens(ids)
    got = sorted((r["token"], r["position"], r["doc_id"] or -1, r["at"]) for r in wavelet.occurrences(spark, path, [*asked, 10**7, -1]).collect())
    assert got == [(t, int(i), owner[i] or -1, inside[i]) for t in asked for i in np.flatnonzero(ids == t)]


def test_tokens_at(spark, corpus):
    path, ids, *_ = corpus
    n = len(ids)
    at = [0, 1, n - 1, n - 2, *range(7, n, 53)]
    rows = spark.createDataFrame([(i, "x") for i in [*at, 0, None, -1, n, n + 10**12]], "position long, token string")
    got = {r["position"]: r["token"] for r in wavelet.tokens_at(spark, path, rows).collect()}
    assert got == {i: int(ids[i]) for i in at}
    assert wavelet.tokens_at(spark, path, rows.limit(0)).collect() == []


def test_many_positions_equal_single_ones():
    ids = np.random.default_rng(3).integers(0, 500, 3001).astype("<u2")
    w = wavelet.WaveletMatrix.build(ids, 9)
    assert (w.access_many(np.arange(3001)) == ids).all()
    for t in (0, 17, 499, 511, 512, -1):
        assert w.find(t).tolist() == np.flatnonzero(ids == t).tolist()

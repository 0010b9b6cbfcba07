"""The operators against brute force, round trips and held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lakewright.llm import (decontaminate, exact_dedup, license_scan, ngram_join, packing, pii, quality, toxicity,
                            url_filter, wavelet)
from lakewright.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
LONG = "pneumo " * 40_000 + "1" * 100_000 + " a@b.c 4111 1111 1111 1111"
EDGE = [(1, None, "en", "s"), (2, "", "en", "s"), (3, " \t\n", "en", None), (4, "The Cat sat on the mat.", "en", "s"),
        (4, "The Cat sat on the mat.", "en", "s"), (5, "the cat  sat on the mat.", None, "t"), (None, "the cat", "en", "t"),
        (6, LONG, "en", "t"), (7, "mail a@b.co +1 (555) 123-4567 10.0.0.256 10.0.0.1 mit license CC-BY", "en", "s"),
        (8, "i d i o t 1d10t €\U0001f600", "en", "s"), (9, "one two", "en", "s"), (10, "One  two", "en", "s")]
EXTRA = "lang string, source string, n_chars long, score double, id long, text_sha256 string, key string, n int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def edge(spark, rows):
    full = [(i, t, lang, s, 0, 0.0, 7, "x", "y", 1) for i, t, lang, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, " + EXTRA)


def operators(spark):
    bench = spark.createDataFrame([(1, "the cat sat on the mat", 9.0), (2, None, 1.0), (3, "one", 0.0)],
                                  "item_id long, text string, start double")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 11)] + [(None, 1, 1), (4, None, None)],
                                   "doc_id long, quality int, toxic int")
    return {
        "quality": lambda d: quality.score_quality(d, quality.fit_quality(d, labels)),
        "join": lambda d: ngram_join.ngram_components(d, 4, 85),
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)),
        "exact": exact_dedup.exact_dedup,
        "license": license_scan.license_scan,
        "pii": pii.find_personal_data,
        "tokens": lambda d: _shards(d),
        "bench": lambda d: decontaminate.contaminated(d, bench),
        "pack": lambda d: packing.pack(d, tokenizer_path(BYTE), True, 0),
    }


def _shards(d):
    from uuid import uuid4

    from lakewright.session import require_checkpoint_dir
    path = f"{require_checkpoint_dir(d.sparkSession)}/shards-{uuid4().hex}"
    wavelet.write_token_shards(d, path, tokenizer_path(WORD), False, 2)
    return wavelet.read_token_shards(d.sparkSession, path)


@pytest.mark.parametrize("name", ["quality", "join", "toxicity", "exact", "license", "pii", "tokens", "bench", "pack"])
def test_edge_rows_and_empty_table(spark, name):
    op = operators(spark)[name]
    rows = op(edge(spark, EDGE)).collect()
    if name == "bench":
        assert {(r["doc_id"], r["item_id"]) for r in rows} == {(4, 1), (5, 1), (9, 3), (10, 3)}
    elif name == "pack":
        lengths = defaultdict(int)
        for r in rows:
            lengths[r["doc_id"]] += r["length"]
        assert lengths[2] == 1 and lengths[1] == 1 and set(lengths) == {r[0] for r in EDGE}
    else:
        assert len(rows) == len(EDGE)
    if name == "join":
        by = {r["doc_id"]: r for r in rows}
        assert by[1]["n_shingles"] == 0 and by[9]["component_id"] == by[10]["component_id"] == 9
        assert by[4]["component_id"] == by[5]["component_id"] == 4 and by[None]["component_id"] is None
    if name == "exact":
        assert sum(r["kept"] for r in rows if r["doc_id"] in (1, 2, 3)) == 1
        assert sum(r["kept"] for r in rows if r["doc_id"] == 4) == 1
    assert op(edge(spark, [])).collect() == []


def test_exact_dedup(spark, docs, texts):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    want = {i: (min(v)[1], len(v), i == min(v)[1], hashlib.sha256(k.encode()).hexdigest())
            for k, v in groups.items() for _, i in v}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
           for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == want
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, v in want.items() if v[2]}


def test_binary_fuse_filter():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 10, 1000, 100_000):
        keys = rng.integers(0, 2**63, n, dtype=np.uint64)
        f = exact_dedup.BinaryFuseFilter.build(keys)
        assert f.may_hold(keys).all()
        assert f.may_hold(rng.integers(2**63, 2**64, 100_000, dtype=np.uint64)).mean() < 0.01


@pytest.mark.parametrize("words,threshold", [(4, 85), (5, 80), (2, 50)])
def test_ngram_components(spark, docs, texts, words, threshold):
    extra = [(10_000 + j, " ".join(t.split()[:-k] + ["zz"] * k)) for k in (1, 3, 9) for j, t in
             ((100 * k + i, t) for i, t in list(texts.items())[:40])]
    every = {**texts, **dict(extra)}
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    sets = {}
    for i, t in every.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = ({tuple(w[j:j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in ngram_join.ngram_components(d, words, threshold).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_rounds_with_cut_lists_test_every_pair():
    """However few partners a round allows, the rounds reach the same links."""
    rng = np.random.default_rng(11)
    n = 60
    sets = [np.unique(rng.choice(500, rng.integers(60, 90), replace=False)).astype(np.uint64) for _ in range(n)]
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    sets, size, ids = [sets[i] for i in order], size[order], np.arange(n)
    counts = [b"" if i % 7 == 0 else ngram_join.class_counts(ngram_join._mix(s)) for i, s in enumerate(sets)]
    comp = np.where(ids % 3 == 0, 0, ids)
    whole = set(zip(*(x.tolist() for x in ngram_join._tile_cross_pairs(size, ids, comp, counts, 20, 10**9)[:2])))
    seen, most = set(), 1
    while True:
        a, b, cut = ngram_join._tile_cross_pairs(size, ids, comp, counts, 20, most)
        assert np.bincount(a, minlength=n).max() <= most
        seen |= set(zip(a.tolist(), b.tolist()))
        if not cut:
            break
        most *= 4
    assert seen == whole and all(comp[x] != comp[y] for x, y in whole)
    for i in range(n):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if comp[i] != comp[j] and 100 * both >= 20 * (size[i] + size[j] - both):
                assert (i, j) in whole or (j, i) in whole


def test_bounds_never_below_overlap():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = rng.integers(0, 2**64 - 1, 300, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 290))) for _ in range(2))
        both = len(np.intersect1d(a, b))
        assert ngram_join.overlap_bound(ngram_join.bitmap(a), len(a), ngram_join.bitmap(b), len(b)) >= both
        x, y = (np.frombuffer(ngram_join.class_counts(s), np.uint8) for s in (a, b))
        assert np.minimum(x, y).sum() >= both


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(tokenizer_path(BYTE))
    pieces = defaultdict(list)
    rows = packing.pack(docs, tokenizer_path(BYTE), True, 0, window=1 << 14).collect()
    for r in rows:
        pieces[r["doc_id"]].append(r)
    total = 0
    for i, t in texts.items():
        ids, at = np.array(tk.encode(t, add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:at].tobytes())
        assert at == len(ids)
        total += at
    lengths = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == lengths[r["sequence_id"]]
        lengths[r["sequence_id"]] += r["length"]
    assert sorted(lengths) == list(range(len(lengths))) and sum(lengths.values()) == total
    assert all(n == 1024 or n & (n - 1) == 0 for n in lengths.values())


def test_schedule_keeps_targets_and_drops_nothing():
    s = packing.Schedule({"a": 5000, "b": 3000, "c": 977}, {"a": 0.2, "b": 0.7, "c": 0.1}, 100)
    for x in ("a", "b", "c"):
        q = [s.quota(x, k) for k in range(s.windows + 1)]
        assert q[0] == 0 and q[-1] == s.totals[x] and q == sorted(q)
        assert all(q[s.window_of(x, t)] <= t < q[s.window_of(x, t) + 1] for t in range(0, s.totals[x], 37))
    assert all(abs(s.quota("b", k) - 70 * k) <= 1 for k in range(40))


def test_wavelet_matrix():
    ids = np.random.default_rng(5).integers(0, 900, 5000).astype("<u2")
    w = wavelet.WaveletMatrix.build(ids, 16)
    assert (w.decode() == ids).all() and [w.access(i) for i in range(0, 5000, 97)] == ids[::97].tolist()
    for token in (int(ids[0]), int(ids[4999]), 901, 70000):
        at = np.flatnonzero(ids == token)
        assert w.count(token) == len(at) and w.rank(token, 2500) == (at < 2500).sum()
        assert [w.select(token, k) for k in range(len(at))] == at.tolist()


def test_token_shards(spark, docs, texts):
    from tokenizers import Tokenizer
    tk, at = Tokenizer.from_file(tokenizer_path(WORD)), 0
    got = {r["doc_id"]: r for r in _shards(docs).collect()}
    for i in sorted(texts):
        ids = tk.encode(texts[i], add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"]) == (at, len(ids))
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_chunked_ids_equal_whole_text_ids():
    from lakewright.llm.tokens import encoder
    odd = ["", " ", "a  b", " a", "a \nb\n c  ", "x\t y\r\n  z", "don't  's 't we're", "́x ́ é É  İstanbul ΑΣ.",
           "a\x1c b \x1d c", "\x85 a\x85 b", "　 x 　y", "a <|endoftext|> b", "12 34  5 !! ' s's", "a​ b"]
    rng = np.random.default_rng(5)
    letters = np.array(list("aAbSß '\"’.,!_-1²½ \t\n\r éÉİſlrv") + [chr(i) for i in range(0xa0, 0x250, 7)])
    odd += ["".join(rng.choice(letters, n)) for n in rng.integers(0, 40, 5000)]
    for name, joined in ((BYTE, True), (WORD, False)):
        e = encoder(tokenizer_path(name), joined)
        want = [np.array(x.ids, e.dtype).tobytes() for x in e.tokenizer.encode_batch(odd, add_special_tokens=False)]
        assert e.encode(odd) == want and e.encode(odd) == want


def test_license_base(docs, texts):
    want = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [(j, label) for p, label in license_scan.BASE.items() for j in range(len(w)) if w[j:j + len(p.split())] == p.split()]
        want[i] = (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})))
    rows = license_scan.license_scan(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows} == want
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in rows)


def test_license_templates_by_containment(spark):
    text = "x " * 50 + "released software under the MIT license" + " y" * 50
    rows = {r["doc_id"]: r for r in license_scan.license_scan(edge(spark, [(1, text, "en", "s"), (2, "released under it", "en", "s")])).collect()}
    assert "mit-notice" in rows[1]["labels"] and rows[1]["n_base"] == 1 and rows[2]["labels"] == "" and rows[2]["score"] == 0


def test_license_blocks_equal_brute_force_over_all_offsets(spark):
    body = " ".join(f"term{i} of the" for i in range(60))
    templates = {**license_scan.TEMPLATES, body: "body"}
    mit = next(t for t, label in templates.items() if label == "mit-text").split()
    rng = np.random.default_rng(3)
    spread = {i * 31 // 11: w for i, w in enumerate(mit[:12])}
    texts = [["x"] * pad + [spread.get(i, "y") for i in range(32)] + ["x"] * 40 for pad in range(34)]
    for t in map(str.split, templates):
        for share in (0.7, 0.8, 0.9, 1.0):
            for gap in (0, 1, 2):
                some = [w for w in t if rng.random() < share]
                texts.append(["x"] * int(rng.integers(40)) + [w for s in some for w in (s, *["y"] * int(rng.integers(gap + 1)))]
                             + ["the", "of", "x"] * int(rng.integers(9)))
    want = {}
    for i, text in enumerate(texts):
        for t, label in templates.items():
            tokens, width = set(t.split()), max(32, 2 * len(t.split()))
            best = max(len(tokens & set(text[at:at + width])) for at in range(len(text)))
            if 100 * best >= 80 * len(tokens):
                want[i, label] = best / len(tokens)
    words = spark.createDataFrame(list(enumerate(texts)), "key long, words array<string>")
    rows = license_scan.template_matches(words, templates, 80).collect()
    assert {(r["key"], r["label"]): r["containment"] for r in rows} == want and len(rows) == len(want)
    assert {(i, "mit-text") for i in range(34)} <= set(want) and "body" in {label for _, label in want}


def test_personal_data_base(spark, docs, texts):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, m):
        d = [int(c) for c in m if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(x if j % 2 == 0 else 2 * x - 9 * (x > 4) for j, x in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15
    hard = {90001: "a@b.c%d@e.f x@y@z.com .@a.b 1.2.3.4.5 0255.1.1.256 00255.1.1.1 é4111 1111-1111 1111 +12 (345)  678-90 +1-2",
            90002: "12345678901 4111111111111111 +14111111111111111", 90003: "@" * 50 + "a" * 5000 + "." * 50}
    every = {**texts, **hard}
    rows = pii.find_personal_data(docs.select("doc_id", "text").unionByName(
        spark.createDataFrame(list(hard.items()), "doc_id long, text string"))).collect()
    for r in rows:
        spans = sorted((m.start(), n, m.end(), k) for n, k in enumerate(patterns)
                       for m in re.finditer(patterns[k], every[r["doc_id"]]) if valid(k, m[0]))
        written = ",".join(f"{k}:{a}:{z}" for a, _, z, k in spans)
        assert [r[f"n_{k}"] for k in patterns] == [sum(s[3] == k for s in spans) for k in patterns], r["doc_id"]
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(written.split(",")) <= set(r["spans"].split(","))


def test_personal_data_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"word{chr(97 + i)} write to user{i}@mail.org today", "en", "s") for i in range(8)]
    rows.append((50, "please write to agent007(at)mail today", "en", "s"))
    got = {r["doc_id"]: r for r in pii.find_personal_data(edge(spark, rows)).collect()}
    assert got[50]["n_email"] == 0 and got[50]["n_added"] == 1 and got[50]["spans"] == "email:16:32"


def test_decontamination(spark):
    item = " ".join(f"w{i}" for i in range(40))
    near = item.replace("w0 ", "other ")
    rows = [(1, "a b c " + item.upper() + ", d", "en", "s"), (2, "x " * 31 + near + " y" * 9, "en", "s"),
            (3, " ".join(f"w{i}" for i in range(0, 40, 2)), "en", "s"), (4, "w1 w2 w3 w4 w5 w6 w7 z", "en", "s")]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    d = edge(spark, rows)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(d, bench).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7]["start"] == 3 and got[1, 7]["similarity"] == 1.0
    kept = decontaminate.drop_contaminated(d, bench)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {3, 4}


def test_decontamination_of_passages_cut_at_the_documents_ends(spark):
    w = [f"w{i}" for i in range(40)]
    pad = ["x"] * 30
    cut = [pad + w[:-1], w[1:] + pad, w[3:] + pad, w[:-1], w[2:], w[:25]]
    d = edge(spark, [(i, " ".join(c), "en", "s") for i, c in enumerate(cut)])
    bench = spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")
    got = {r["doc_id"]: (r["start"], r["n_words"], r["similarity"]) for r in decontaminate.contaminated(d, bench).collect()}
    assert got == {0: (29, 40, 35 / 37), 1: (0, 40, 35 / 37), 2: (0, 40, 33 / 39), 3: (0, 39, 35 / 36), 4: (0, 38, 34 / 36)}


@pytest.mark.parametrize("threshold", [80, 50])
def test_decontamination_equals_brute_force_over_all_windows(spark, threshold):
    rng = np.random.default_rng(5)
    items = {i: [f"w{i}x{rng.integers(60)}" for _ in range(n)] for i, n in enumerate((15, 36, 40, 40, 59))}

    def pad():
        return [f"x{j}" for j in rng.integers(0, 500, rng.integers(0, 30))]
    texts = []
    for w in items.values():
        h = len(w) // 2
        for body in (w, w[h:] + w[:h], w[h:] + w[:h - 2], w[h:] + ["mid"] + w[:h], w[9:] + w[:9], w[2:] + w[:1], w[:h] + pad() + w[h:]):
            texts += [pad() + body + pad(), body, pad() + body]
    texts.append(sum(items.values(), []))

    def bag(w):
        return Counter(zip(*(w[j:] for j in range(5))))
    want = {}
    for d, t in enumerate(texts):
        for i, w in items.items():
            for at in range(max(1, len(t) - len(w) + 1)):
                a, b = bag(t[at:at + len(w)]), bag(w)
                both, every = sum((a & b).values()), sum((a | b).values())
                if 100 * both >= threshold * every:
                    want[d, i] = max(want.get((d, i), (0, 0, 0)), (both / every, -at, min(len(t), len(w))))
    d = edge(spark, [(j, " ".join(t), "en", "s") for j, t in enumerate(texts)])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], -r["start"], r["n_words"])
           for r in decontaminate.contaminated(d, bench, threshold).collect()}
    missing = {k: v for k, v in want.items() if got.get(k) != v}
    if threshold == 80:
        assert len(want) > 40 and got == want
    else:                                                   # at 50 % some fingerprints are beyond the radius
        assert set(got) <= set(want) and len(missing) <= len(want) / 20


def test_url_rules_and_propagation(spark):
    link = '<a href="http://bad.example.com/x">b</a>'
    urls = [(1, "http://WWW.Example.NET/en/x?q", ""), (2, "https://a.net", ""), (3, "https://a.net/", ""), (4, None, None),
            (5, "no scheme", ""), (6, "http://bad.example.com/de/1", ""), (7, "http://bad.example.com/en/1", ""),
            (8, "http://friend.info/a", link), (9, "http://x.org/fr/2#f", ""), (10, "http://neutral.info", ""), (3, "https://a.net/", "")]
    rows = url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string, html string")).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == 11
    assert got[1] == ("www.example.net", "/en/x", "example.net/en/", "allow") and got[2][2] is None
    assert got[3] == ("a.net", "/", "net/", "block") and got[4] == ("", "", None, "allow") == got[5]
    assert got[6][2:] == ("example.com/de/", "block") and got[7][2:] == (None, "block")
    assert got[9][2:] == ("org/fr/", "allow") and got[10][3] == "allow"
    assert {r["page_id"]: r["distrust"] for r in rows}[8] > 0
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("name,label", [("op1_bradley_terry_quality", "quality"), ("op3_noisy_channel_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    d = "/root/testdata/sf0.01"
    y = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in QUERIES[name](spark, d).collect() if r["doc_id"] in y]
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % (3 if label == "quality" else 5) == (label == "quality"))
               for r in rows)
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in held]) > 0.93


def test_toxic_words_are_restored(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from lakewright.llm.common import docs_of
    model = toxicity.count_characters(docs_of(d).select("text"))
    assert [toxicity.decode(w, model) for w in ("1d10t", "tr@sh", "st.u.p.i.d", "iddiioot")] == ["idiot", "trash", "stupid", "idiot"]
    assert toxicity.spaced_runs("you i d i o t, a b") == ["idiot"]


@pytest.fixture(scope="module")
def counts(spark):
    return toxicity.count_characters(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").where("text is not null"))


def read_words(spark, counts, text):
    units = spark.createDataFrame([(u,) for u in toxicity.units_of(text.lower())], "unit string")
    return toxicity.words_of_text(text, {r["unit"]: r["restored"] for r in toxicity.restore(units, counts).collect()})


def test_every_odd_token_is_decoded(spark, counts):
    for text in ("iddiioot", '"1d10t"', "(1d10t)", "[1d10t],", "'id1ot!'", "1d107"):
        assert "idiot" in read_words(spark, counts, text), text
    assert "hate" in read_words(spark, counts, "h473")
    assert "455" in toxicity.units_of("a 455 b") and "a$$" in toxicity.units_of("(a$$)") and "@$$" in toxicity.units_of('"@$$"')


def test_no_state_of_the_lattice_is_cut():
    class Late:                                                # only the last letter tells which reading was meant
        def __init__(self, tail):
            self.tail = tail

        def step(self, before, char):
            return -50.0 if char == b"e" and before.endswith(self.tail) else 0.0
    for tail in (b"1!1", b"l!1", b"1i1", b"i!1", b"lil"):
        assert toxicity.decode("1!1e", Late(tail)) == tail.decode() + "e"


def test_decode_finds_the_cheapest_of_all_paths(counts):
    for token in ("k!11er", "1d10t", "a$$", "s7up1dd"):
        model, paths = counts.model_of([token]), [(0.0, b"", "", "")]
        for ch in token:
            ways = [(ch, 0.0 if ch.isalpha() else 1.5)] + [(x, toxicity.SUBSTITUTION) for x in toxicity.LOOKALIKES.get(ch, "")]
            paths = [(c + p + (model.step(t, x.encode()) if x else 0.0), (t + x.encode())[-3:], out, w + x)
                     for c, t, last, w in paths for out, price in ways
                     for x, p in [(out, price)] + [("", toxicity.COLLAPSE)] * (out == last)]
        assert toxicity.decode(token, counts) == min((c + model.step(t, b" "), w) for c, t, _, w in paths)[1]


def test_spaces_are_in_the_lattice(spark, counts):
    for text in ("you are a s t u p i d man", "I s t u p i d", "so  s\tt\nu  p i d.", "a s 7 u p 1 d"):
        assert "stupid" in read_words(spark, counts, text), text
    assert toxicity.decode("stu pid", counts) == "stupid" and toxicity.decode("the man", counts) == "the man"
    model = toxicity.ToxicityModel(None, {"=stupid": 3.0, "^stup": 2.0}, np.empty(0))
    n, words, weights, units = model.prepare("you are stu pid, or s t u  p i d, my man")
    assert units == ["s t u p i d", "stu pid"] and words == []
    assert model.evidence(n, words, weights, units, {u: toxicity.decode(u, counts) for u in units})[:2] == [3.0, 3.0]


def test_character_counts_are_exact(spark):
    texts = ["The cat", "a catalogue\n of cats \u20ac", ""] + [chr(0x4e00 + i) * 2 + chr(0x5e00 + 3 * i) for i in range(9000)]
    got = {r["key"]: r["n"] for r in toxicity.count_characters(spark.createDataFrame([(t,) for t in texts], "text string")
                                                               .coalesce(1)).table.collect()}
    raw = "   ".join(["", *" ".join(texts).lower().split(), ""]).encode()
    want = Counter(int.from_bytes(raw[i:i + 4], "big") for i in range(len(raw) - 3))
    assert {k: v for k, v in got.items() if k >= 0} == want
    contexts = Counter()
    for k, v in got.items():
        if k >= 0:
            contexts[-(k >> 8) - 1] += v
    assert {k: v for k, v in got.items() if k < 0} == contexts and len(want) > 2 ** 14


def test_pipeline(spark):
    import corpus_pipeline
    rows = corpus_pipeline.run(spark, SF).collect()
    lengths = defaultdict(int)
    for r in rows:
        lengths[r["sequence_id"]] += r["length"]
    assert rows and all(n == 1024 or n & (n - 1) == 0 for n in lengths.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "exact_dedup", "near_duplicates", "decontamination", "packing"]


def test_license_marks_tell_a_family_apart(spark):
    texts = {1: "licensed under CC BY-SA 4.0", 2: "licensed under CC BY 4.0", 3: "licensed under CC BY-NC 4.0 now",
             4: "This work is licensed under a Creative Commons Attribution 4.0 International License",
             5: "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"}
    rows = {r["doc_id"]: r["labels"] for r in license_scan.license_scan(edge(spark, [(i, t, "en", "s") for i, t in texts.items()])).collect()}
    assert rows == {1: "cc-by,cc-by-sa-notice", 2: "cc-by", 3: "cc-by,cc-by-nc-notice", 4: "cc-by-notice", 5: ""}


def test_license_scan_of_a_long_text_of_template_words(spark):
    text = "license work the under this apache licensed " * 20_000 + "this work is licensed under the gnu general public license version 3"
    r = license_scan.license_scan(edge(spark, [(1, text, "en", "s")])).first()
    assert r["n_words"] == 140_012 and "gpl-notice" in r["labels"] and r["base_labels"] == "gpl"


def test_dropping_exact_duplicates_goes_by_row(spark):
    low = -(2 ** 63)
    rows = [(4, "a b"), (4, "ab"), (0, "b"), (1, "b"), (1, "c"), (low, "d"), (7, "d"), (8, " d"), (None, "e"), (None, "e"), (2, None), (3, "")]
    kept = exact_dedup.drop_exact_duplicates(edge(spark, [(i, t, "en", "s") for i, t in rows])).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(4, "a b"), (0, "b"), (1, "c"), (8, " d"), (None, "e"), (2, None)], key=str)
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(edge(spark, [(low, "x", "en", "s"), (5, "x", "en", "s")])).collect()}
    assert got == {low: low, 5: low}

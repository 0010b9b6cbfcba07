"""Lexical search, nearest vectors and conversation repair against brute force."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lakewright.llm import conversations, lexical, nearest
from lakewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# --- conversation repair -----------------------------------------------------

def repaired(rows):
    """Every conversation by a search over whole audits, cheapest and then least first."""
    of, text = defaultdict(list), lambda x: " " if x is None else str(x)
    for conv, turn, role, words in rows:
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, words = text(role), text(words)
        if kind:
            words = "" if kind == 1 else re.sub("[.!?]", "", words) if kind == 2 else words
            of[conv] += [(turn, "user" if kind == 4 else role, words)] * (2 if kind == 3 else 1)
    out = {}
    for conv in {r[0] for r in rows}:
        said = sorted(of[conv], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns, faults, seen = [x[0] for x in said if x[0] is not None], [], set()
        for _, role, words in said:
            solid = re.sub(r"[\x20\x09-\x0D]", "", words)
            faults.append("blank" if not solid else "duplicate" if (role, words) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, words))
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, roles, texts = heapq.heappop(heap)
            if i == len(said) and (not roles or (roles[-1] == "a" and said)):
                break
            if (i, roles[-1:]) in done:
                continue
            done.add((i, roles[-1:]))
            fits = lambda x: x == "s" and not roles or x == "u" and roles[-1:] in ("", "s", "a") or x == "a" and roles[-1:] == "u"
            for role in ("user", "assistant"):
                if fits(role[0]):
                    heapq.heappush(heap, (cost + 2, audit + "I", i, roles + role[0], (*texts, role + ":")))
            if i < len(said):
                _, role, words = said[i]
                heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, texts))
                if faults[i] in ("", "truncated"):
                    more = cost + bool(faults[i])
                    if role and fits(role[0]):
                        heapq.heappush(heap, (more, audit + "K", i + 1, roles + role[0], (*texts, f"{role}:{words}")))
                    for new in ("user", "assistant"):
                        if fits(new[0]):
                            heapq.heappush(heap, (more + 2, audit + "R", i + 1, roles + new[0], (*texts, f"{new}:{words}")))
        counts = Counter(faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


def same(got, rows):
    got, want = {r["conv_id"]: tuple(r) for r in got}, repaired(rows)
    assert got == want


def test_repair_of_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(QUERIES["op11_block_table_repair"](spark, SF).collect(), rows)


def test_repair_of_odd_conversations(spark):
    draw, rows = random.Random(5), []
    roles, texts = ["system", "user", "assistant", "user", "tool", "", None, "Sam", "ua"], ["a.", "b", "c!", " ", "", "d?\t", "e .", None, "é?　", "\x0b"]
    for conv in [*range(600), None, -(2 ** 63)]:
        rows += [(conv, draw.choice([t, t, None, 2 * t, 3]), draw.choice(roles), draw.choice(texts)) for t in range(draw.randint(1, 11))]
    rows += [(7, 1, "user", "a.")] * 3
    full = [(*r, 0, "x", True) for r in rows]
    df = spark.createDataFrame(full, "conv_id long, turn long, role string, text string, at int, audit string, gone boolean")
    same(conversations.damage_and_repair(df).collect(), rows)
    assert conversations.damage_and_repair(df.limit(0)).collect() == []


def test_a_long_conversation_goes_by_in_batches(spark):
    n = 30_000
    rows = [(1, t, ("user", "assistant")[t % 2], "word. " * (20_000 if t == 9 else 1) + str(t) + ".") for t in range(n)]
    got = conversations.damage_and_repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    gone = sum(zlib.crc32(f"1:{t}".encode()) % 20 == 0 for t in range(n))
    assert got["gaps"] <= gone and len(got["audit"]) >= n - gone and got["blank"] > n / 30


def test_block_tables_agree_with_single_rows():
    vectors, step, cost = conversations.tables()
    draw = random.Random(1)
    for _ in range(300):
        block = [draw.randrange(conversations.SYMBOLS) for _ in range(conversations.BLOCK)]
        v = draw.randrange(len(vectors))
        want = vectors[v]
        for r in reversed(block):
            want = conversations.before(r, want)
        code = 0
        for r in block:
            code = code * conversations.SYMBOLS + r
        assert tuple(x + cost[v, code] for x in vectors[step[v, code]]) == want


# --- lexical search ----------------------------------------------------------

def ranked(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(split(t))) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df, of = Counter(t for _, b in bags for t in b), defaultdict(set)
    for item, t in items:
        of[item] |= set(split(t))
    out = []
    for item, words in of.items():
        scored = []
        for i, b in bags:
            if i is not None and length:
                m = 10 + 90 * sum(b.values()) * n_docs // length
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 8 * m)) for t in words if b[t])
                scored += [(-s, i)] if s else []
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("block_items", [4_096, 3])
def test_search_against_brute_force(spark, monkeypatch, block_items):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block_items)
    monkeypatch.setattr(lexical, "CELLS", 500)
    draw = random.Random(2)
    words = ["the", "The", "é", "ÉA", "a1", "x_y", "zz", "日本", "q", "w9"]
    docs = [(i, " ".join(draw.choices(words, k=draw.randint(0, 30)))) for i in range(300)]
    docs += [(i, "the zz zz. q") for i in range(300, 340)] + [(5, "zz"), (5, "zz"), (None, "zz q"), (900, None), (901, " \x00-"), (902, "zz the " * 40_000)]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(0, 5)))) for i in range(12)] + [(3, "zz"), (None, "q"), (99, None), (98, "absent"), (97, "!")]
    d = spark.createDataFrame([(*r, 1, 2, "n") for r in docs], "doc_id long, text string, n int, m long, bag string")
    b = spark.createDataFrame([(*r, 4) for r in items], "item_id long, text string, rank int")
    assert ordered(lexical.rank_documents(d, b).collect()) == ordered(ranked(docs, items, 10))


def test_search_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "zz")], "doc_id long, text string")
    for docs, items in ((d.limit(0), d.withColumnRenamed("doc_id", "item_id")), (d, d.withColumnRenamed("doc_id", "item_id").limit(0)),
                        (spark.createDataFrame([(1, None)], "doc_id long, text string"), d.withColumnRenamed("doc_id", "item_id"))):
        out = lexical.rank_documents(docs, items)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.collect() == []


# --- nearest vectors -----------------------------------------------------------

def true_nearest(rows, every, k):
    out = defaultdict(list)
    for q, v in rows.items():
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows.items() if i != q and len(v) == len(w))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def recall(got, want, k):
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q, best in want.items():
        assert len(by[q]) == len(best) and len({i for i, _ in by[q]}) == len(best)
        assert by[q] == sorted(by[q], key=lambda x: (-x[1], x[0]))
        bar = best[-1][1] - 1e-9 if best else 0
        hits += sum(s >= bar for _, s in by[q])
        total += len(best)
    assert set(by) <= set(want)
    return hits / max(total, 1)


def test_recall_and_scores_on_the_table(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()}
    got = QUERIES["op13_collision_counting"](spark, "/root/testdata/sf0.01").collect()
    assert recall(got, true_nearest(rows, 20, 20), 20) >= 0.95
    for r in got[:200]:
        assert r["score"] == pytest.approx(float(np.dot(np.array(rows[r["query_id"]], float), np.array(rows[r["vec_id"]], float))), abs=1e-14)


def test_recall_over_several_shards_norms_and_copies(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD", 300)
    monkeypatch.setattr(nearest, "GROUP", 20)
    draw = np.random.default_rng(4)
    m = draw.standard_normal((1500, 24)) * draw.uniform(0.1, 9, (1500, 1))
    m[400:900] = m[400]                                                 # a third are copies
    rows = {i: v for i, v in enumerate(m.tolist())}
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows.items()], "vec_id long, embedding array<double>, dim int, shard string")
    want = true_nearest(rows, 20, 20)
    got = nearest.nearest(df).collect()
    assert recall(got, want, 20) >= 0.9
    of = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (400, 420)}
    assert all(len(x) == 20 for x in of.values())


def test_vectors_that_take_no_part_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]),
            (7, [nan, 1.0]), (8, [inf, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (9, [1.0, 1.0, 1.0]), (40, [3.0]), (-20, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept = {0: [1.0, 0.0], 20: [0.0, 2.0], 1: [1.0, 1.0], 2: [1.0, 1.0], -20: [-1.0, 0.5], 9: [1.0] * 3, 40: [3.0]}
    got = [tuple(r) for r in nearest.nearest(df).collect()]
    assert sorted(got) == sorted((q, n, i, s) for q, best in true_nearest(kept, 20, 20).items() for n, (i, s) in enumerate(best, 1))
    assert nearest.nearest(df.limit(0)).collect() == []

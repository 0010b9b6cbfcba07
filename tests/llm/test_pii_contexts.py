"""Places in long texts, and what learnt contexts add: recall and precision on planted identifiers."""

import random
import re

from pyspark.sql import functions as F

from lakewright.llm import pii


def test_running_starts(spark):
    rng = random.Random(3)
    lists = [[rng.randrange(50) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 4096, 4097, 20_000)]
    d = spark.createDataFrame(list(enumerate(lists)), "id int, x array<int>")
    got = {r["id"]: r["s"] for r in d.select("id", pii.running_starts(F.col("x")).alias("s")).collect()}
    for i, x in enumerate(lists):
        assert got[i] == [sum(x[:j]) for j in range(len(x))] if len(x) < 5000 else got[i][-1] == sum(x[:-1])


def test_places_across_pieces(spark):
    """Every token of a text of several pieces lies where its text stands, and knows its neighbours."""
    rng = random.Random(5)
    words = [rng.choice(["", "(x1)", "plain", "a@b.co", "+1 555 123 4567", "4111 1111 1111 1111", "é\U0001f6002,"])
             for _ in range(1500)]
    text = " ".join(words)
    d = spark.createDataFrame([(1, text)], "key long, text string").withColumn("base", pii.base_spans(F.col("text")))
    spans = d.first()["base"]
    flat = text.split(" ")
    starts, at = {}, 0
    for i, w in enumerate(flat):
        starts[i], at = at, at + len(w) + 1
    rows = pii._tokens(d).collect()
    by_start = {r["start"]: r for r in rows}
    want = [i for i, w in enumerate(flat) if any(c in "0123456789@" for c in w)]
    assert len(rows) == len(want)
    clean = lambda w: w.lower().strip("(),+")
    for i in want:
        w = flat[i]
        r = by_start[starts[i] + re.search(r"[\w@+]", w, re.A).start()]
        assert text[r["start"]:r["end"]] == r["instance"]
        if i and flat[i - 1].isascii():
            assert r["left1"] == clean(flat[i - 1])
        if i > 1 and flat[i - 2].isascii():
            assert r["left2"] == clean(flat[i - 2])
        if i + 1 < len(flat) and flat[i + 1].isascii():
            assert r["right1"] == clean(flat[i + 1])
        mine = [s for s in spans if s["start"] < r["end"] and s["end"] > r["start"]]
        assert r["covered"] == bool(mine)
        assert r["k"] == (mine[0]["k"] if mine and mine[0]["start"] >= r["start"] else None)


def test_text_of_100_000_identifier_tokens(spark):
    n = 50_000
    text = " ".join(f"id{i} a{i}@b.co" for i in range(n))
    r = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = [s.split(":") for s in r["spans"].split(",") if s.startswith("email")]
    assert r["n_email"] == n and len(spans) == n
    for i in (0, 1, n // 2, n - 1):
        assert text[int(spans[i][1]):int(spans[i][2])] == f"a{i}@b.co"


def test_recall_and_precision_of_learnt_contexts(spark):
    """200 documents with seeds in three contexts, 90 with identifiers that no base pattern matches in the
    same contexts, 200 with digits elsewhere and 200 with digits behind the seeds' last word alone."""
    rng = random.Random(11)
    noise = ["north", "garden", "river", "paper", "window", "stone", "market", "letter"]
    filler = lambda k: " ".join(rng.choice(noise) for _ in range(k))
    contexts = [("email", "please write to", lambda i: f"user{i}@mail.org", lambda i: f"user{i}(at)mail"),
                ("phone", "call me under", lambda i: f"+49301234{1000 + i}", lambda i: f"030/1234{1000 + i}"),
                ("ip", "server listens on", lambda i: f"10.{i // 200}.{i % 200}.7", lambda i: f"fe80::{i}:7")]
    rows, planted = [], {}
    for i in range(200):
        _, before, seed, _ = contexts[i % 3]
        rows.append((i, f"{filler(4)} {before} {seed(i)} {filler(3)}"))
    for i in range(200, 290):
        kind, before, _, unseen = contexts[i % 3]
        head = f"{filler(4)} {before} "
        planted[i] = (kind, len(head), len(head) + len(unseen(i)))
        rows.append((i, f"{head}{unseen(i)} {filler(3)}"))
    rows += [(i, f"{filler(3)} page {i} of chapter {i % 9} from 19{i % 90 + 10} {filler(3)}") for i in range(300, 500)]
    rows += [(i, f"{filler(3)} went back {('to', 'under', 'on')[i % 3]} {i % 37} {filler(3)}") for i in range(500, 700)]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {(r["doc_id"], *s.split(":")) for r in got if r["n_added"] for s in r["spans"].split(",")}
    want = {(i, k, str(a), str(z)) for i, (k, a, z) in planted.items()}
    recall, precision = len(added & want) / len(want), len(added & want) / max(1, len(added))
    assert recall >= 0.95 and precision >= 0.95, (recall, precision)

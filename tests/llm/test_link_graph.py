"""PageRank over host edges against the dense solution, and rows at the edges of the table."""

import numpy as np
import pytest

from lakewright.llm import url_filter


def dense(n, edges, seed, damping=0.85):
    """The stationary ranks: mass of hosts without outgoing edges goes back to the seeds."""
    p = np.zeros((n, n))
    for a, b, w in edges:
        p[a, b] += w
    total = p.sum(1)
    for a in range(n):
        p[a] = p[a] / total[a] if total[a] else seed
    return np.linalg.solve(np.eye(n) - damping * p.T, (1 - damping) * np.array(seed))


def graphs():
    rng = np.random.default_rng(7)
    chain = [(i, i + 1, 1.0) for i in range(20)]
    some = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (90, 2)) if a != b and a % 5})
    return {"chain": (21, chain, {0: 1.0}),
            "dangling": (40, [(a, b, float(1 + (a * b) % 4)) for a, b in some], {3: 0.5, 8: 0.3, 39: 0.2}),
            "loop": (3, [(0, 1, 2.0), (1, 0, 1.0), (1, 2, 1.0)], {0: 0.25, 1: 0.75}),
            "alone": (2, [(1, 0, 1.0)], {0: 1.0})}


def test_ranks_equal_the_dense_solution(spark):
    every = graphs()
    edges = spark.createDataFrame([(k, f"h{a}", f"h{b}", w) for k, (_, es, _) in every.items() for a, b, w in es],
                                  "kind string, src string, dst string, w double")
    seeds = spark.createDataFrame([(k, f"h{a}", s) for k, (_, _, ss) in every.items() for a, s in ss.items()],
                                  "kind string, host string, seed double")
    got = {(r["kind"], r["host"]): r["rank"] for r in url_filter.spread(edges, seeds, 1e-7).collect()}
    for k, (n, es, ss) in every.items():
        want = dense(n, es, [ss.get(i, 0.0) for i in range(n)])
        assert np.allclose([got.get((k, f"h{i}"), 0.0) for i in range(n)], want, atol=1e-6), k
    assert got["chain", "h20"] > 0


@pytest.fixture(scope="module")
def chain(spark):
    """Twenty hosts that link on to a blocked one; long and empty fields, a repeated row, clashing names."""
    link = '<a href="https://{}/x">'.format
    rows = [(i, f"http://site{i}.info/a", link(f"site{i + 1}.info")) for i in range(20)]
    rows += [(20, "http://site20.info/", link("bad.net")), (21, "http://bad.net/", None), (22, None, None), (23, "", ""),
             (24, "no scheme", link("site0.info")), (25, "http://" + "a" * 100_000 + ".org/" + "p" * 100_000, "x" * 300_000),
             (26, "http://site3.info/a", link("site4.info")), (26, "http://site3.info/a", link("site4.info")), (None, "http:///", "")]
    return [(*r, "t", "d", 1.0, "r") for r in rows]


def test_edge_rows_and_a_long_chain(spark, chain):
    schema = "page_id long, url string, html string, trust string, host string, rank double, rule string"
    rows = url_filter.judge_urls(spark.createDataFrame(chain, schema)).collect()
    assert len(rows) == len(chain)
    by = {}
    for r in rows:
        by.setdefault(r["page_id"], []).append(r)
    ranks = [by[i][0]["distrust"] for i in range(21)]
    assert all(r > 0 for r in ranks) and ranks == sorted(ranks)        # reaches the far end, weaker with each hop
    assert by[21][0]["verdict"] == "block" and by[21][0]["rule"] == "net/"
    assert by[20][0]["verdict"] == "block" and by[20][0]["rule"] is None
    assert [(r["host"], r["verdict"]) for i in (22, 23, 24, None) for r in by[i]] == [("", "allow")] * 4
    assert len(by[25][0]["host"]) == 100_004 and by[25][0]["verdict"] == "allow"
    assert len(by[26]) == 2 and by[26][0] == by[26][1]
    assert url_filter.judge_urls(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("margin", [0.2, 1.0, 3.0])
def test_verdicts_equal_the_dense_solution(spark, margin):
    """Random links among hosts, some blocked and some allowed: stopping early changes no verdict."""
    rng = np.random.default_rng(11)
    names = [f"h{i}.{('net', 'org', 'info', 'info')[i % 4]}" for i in range(48)]
    links = [[names[int(j)] for j in rng.integers(0, 48, int(rng.integers(0, 5)))] for _ in names]
    rows = [(i, f"http://{n}/fr/x", "".join(f'<a href="https://{t}/">' for t in links[i])) for i, n in enumerate(names)]
    got = {r["page_id"]: r for r in url_filter.judge_urls(
        spark.createDataFrame(rows, "page_id long, url string, html string"), margin=margin).collect()}
    edges = [(i, names.index(t), 1.0) for i, ts in enumerate(links) for t in ts if t != names[i]]
    seeds = {v: np.array([float(n.endswith(e)) for n in names]) for v, e in (("trust", ".org"), ("distrust", ".net"))}
    trust = dense(48, edges, list(seeds["trust"] / seeds["trust"].sum()))
    distrust = dense(48, [(b, a, w) for a, b, w in edges], list(seeds["distrust"] / seeds["distrust"].sum()))
    for i, n in enumerate(names):
        want = "block" if n.endswith(".net") or (not n.endswith(".org") and distrust[i] - trust[i] > margin / 48) else "allow"
        assert got[i]["verdict"] == want, (i, distrust[i] - trust[i], margin / 48)


def test_undecided_hosts_are_seen(spark):
    def decided(rows, found, border=0.1):
        return url_filter.verdicts_decided(spark.createDataFrame(rows, "kind string, host string, rank double"), found, border)
    assert decided([("distrust", "a", 0.5), ("trust", "b", 0.5)], {"distrust": (0.9, 0.01), "trust": (0.9, 0.01)})
    assert not decided([("distrust", "a", 0.0895)], {"distrust": (0.9, 0.01)})     # 0.098 to 0.109
    assert not decided([("distrust", "a", 0.5)], {"distrust": (0.7, 0.3)})         # hosts not reached yet
    assert not decided([("distrust", "a", 0.5), ("trust", "a", 0.4)], {"distrust": (0.95, 0.01), "trust": (0.95, 0.05)})
    assert decided([], {})

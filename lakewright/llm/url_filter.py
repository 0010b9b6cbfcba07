"""URL filter: host rules, and trust spread over a graph of hosts.

Host: from the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-
cased; path: from there up to ``?``, ``#`` or the end.  A rule (host, path,
verdict) fits its host and all subdomains if the url's path starts with the
rule's; the longest fitting rule wins.

Urls that no rule fits get their host's verdict.  Host edges come from the
pages: a link to another host, and the tie of a host to its parent domain.
Personalised PageRank spreads trust along the edges from hosts whose pages
rules allow, and distrust against them from hosts whose pages rules block;
a host is blocked when its distrust exceeds its trust by more than the margin,
counted in average ranks (1 / hosts).  Ranks are worked out, however long the
chains of hosts are, until no verdict can change any more, or else until what
is left is a hundredth of that margin.

Defined results: a null url or one without ``://`` has empty host and path, no
rule, and the verdict allow; repeated rows are judged alike; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import ship, stage

# Host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DAMPING = 0.85
MARGIN = 1.0
SETTLED = 0.01                     # ranks are exact to this share of the margin
HOPS = 8                           # hops between two staged tables
_LINK = r"(?i)\bhref\s*=\s*[\"']?((?:https?:)?//[^\"'\s>]+)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without ``://``."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null.  Rules
    are a policy given by the caller and part of the plan."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p),
                   F.struct(F.lit(f"{h}{p}").alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))]
    return F.coalesce(*fits)


def host_edges(pages: DataFrame) -> DataFrame:
    """Weighted edges (src, dst, w) between hosts, pre-aggregated: one row per
    pair, so that a host with a third of all pages is one row per target.
    ``pages``: host, html."""
    links = (pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all(
        F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("to"))
        .select(F.col("host").alias("src"), F.regexp_extract(F.col("to"), r"//([^/?#]*)", 1).alias("to"))
        .select("src", lower_ascii(F.col("to")).alias("dst")).where("dst <> '' and dst <> src")
        .groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")))
    hosts = pages.where("host <> ''").select("host").distinct()
    names = F.split("host", r"\.")
    # Every domain above a host, down to two labels; consecutive ones are tied.
    ladder = hosts.select(F.explode(F.when(F.size(names) > 2, F.transform(
        F.sequence(F.lit(0), F.size(names) - 3), lambda i: F.struct(
            F.array_join(F.slice(names, i + 1, F.size(names)), ".").alias("sub"),
            F.array_join(F.slice(names, i + 2, F.size(names)), ".").alias("parent"))))).alias("t")).select("t.*").distinct()
    ties = (ladder.select(F.col("sub").alias("src"), F.col("parent").alias("dst"))
            .unionByName(ladder.select(F.col("parent").alias("src"), F.col("sub").alias("dst")))
            .withColumn("w", F.lit(1.0)))
    return links.unionByName(ties).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def spread(edges: DataFrame, seeds: DataFrame, tolerance: float, damping: float = DAMPING,
           decided: Callable[[DataFrame, dict[str, tuple[float, float]]], bool] | None = None) -> DataFrame:
    """Personalised PageRank (kind, host, rank) from ``seeds`` (kind, host, seed),
    which sum to 1 in every kind, along ``edges`` (kind, src, dst, w).  Mass of a
    host without outgoing edges returns to the seeds.

    A wave leaves the seeds and grows weaker by the damping at every hop, so the
    rounds end by themselves: when all that is still on its way, in every kind,
    is at most ``tolerance`` of the mass that has arrived, or earlier when
    ``decided`` says that the rest cannot matter.  It is given the state (kind,
    host, rank) and per kind the mass arrived and the most that can still arrive.
    """
    if not tolerance > 0:
        raise ValueError("tolerance must be above 0")
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("total"))
    # Every host has a row to itself that keeps its rank, so that a hop is one join and one aggregate.
    hosts = (edges.select("kind", F.explode(F.array("src", "dst")).alias("host")).unionByName(seeds.select("kind", "host")).distinct()
             .select("kind", "host", F.col("host").alias("dst"), F.lit(0.0).alias("p"), F.lit(1.0).alias("own")))
    step = stage(edges.join(out, ["kind", "src"]).select(
        "kind", F.col("src").alias("host"), "dst", (F.col("w") / F.col("total") * damping).alias("p"), F.lit(0.0).alias("own"))
        .unionByName(hosts), "steps")
    state = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"), (F.col("seed") * (1 - damping)).alias("wave"))
    while True:
        for _ in range(HOPS):
            moved = F.col("wave") * F.col("p")
            state = (state.join(step, ["kind", "host"])
                     .select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("own") + moved).alias("rank"), moved.alias("wave"))
                     .groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("wave").alias("wave")))
        state = stage(state, "ranks")
        mass = state.groupBy("kind").agg(F.sum("rank").alias("mass"), F.sum("wave").alias("wave"))
        # A row a kind.  What a wave can still bring is a geometric series.
        found = {r["kind"]: (r["mass"], r["wave"] * damping / (1 - damping)) for r in mass.collect()}
        if all(left <= tolerance * m for m, left in found.values()) or (decided and decided(state.drop("wave"), found)):
            break
    # Lost mass is spread as the seeds: a common factor here, as only the seeds receive it.
    return state.join(F.broadcast(mass.select("kind", "mass")), "kind").select("kind", "host", (F.col("rank") / F.col("mass")).alias("rank"))


def verdicts_decided(state: DataFrame, found: dict[str, tuple[float, float]], border: float) -> bool:
    """Whether no host's distrust less trust can cross ``border`` any more.

    Of mass ``m`` arrived and at most ``left`` to come, a host of rank ``r``
    ends between r / (m + left) and (r + left) / (m + left), and r / m lies
    between the two.  A host that no wave has reached counts as rank 0.
    """
    def ends(kind: str, rank: Column) -> tuple[Column, Column]:
        m, left = found.get(kind, (0.0, 0.0))
        whole = m + left
        return (rank / whole, (rank + left) / whole) if whole else (F.lit(0.0), F.lit(0.0))
    m, left = found.get("distrust", (0.0, 0.0))
    if left > border * (m + left):
        return False                                              # an unreached host could still be blocked
    rank = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)) for k in ("trust", "distrust")}
    hosts = state.groupBy("host").agg(rank["trust"].alias("t"), rank["distrust"].alias("d"))
    (t_low, t_high), (d_low, d_high) = ends("trust", F.col("t")), ends("distrust", F.col("d"))
    return hosts.where((d_low - t_high <= border) & (d_high - t_low > border)).isEmpty()


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, margin: float = MARGIN) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, and the
    host's trust and distrust."""
    rules = rules or RULES
    ship(pages.sparkSession)
    host, path = url_parts(F.col("url"))
    p = (pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
         .withColumn("fit", best_rule(F.col("host"), F.col("path"), rules)))
    edges = stage(host_edges(p.select("host", "html")), "host-edges")
    votes = stage(p.where("host <> ''").groupBy("host").agg(
        F.count_if(F.col("fit.verdict") == "allow").cast("double").alias("allowed"),
        F.count_if(F.col("fit.verdict") == "block").cast("double").alias("blocked"), F.count("*").alias("pages")), "votes")

    # A host's seed is the share of its pages the rules judge, so size alone gives no weight.
    votes_of = votes.select("host", F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), (F.col("allowed") / F.col("pages")).alias("x")),
        F.struct(F.lit("distrust").alias("kind"), (F.col("blocked") / F.col("pages")).alias("x")))).alias("v")).select("host", "v.*").where("x > 0")
    seeds = votes_of.join(F.broadcast(votes_of.groupBy("kind").agg(F.sum("x").alias("all"))), "kind").select(
        "kind", "host", (F.col("x") / F.col("all")).alias("seed"))
    both = edges.select(F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), "src", "dst", "w"),
        F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))).alias("e")).select("e.*")
    n = max(1, votes.count())
    ranks = spread(both, stage(seeds, "seeds"), SETTLED * margin / n,
                   decided=lambda state, found: verdicts_decided(state, found, margin / n))
    hosts = stage(votes.select("host").join(ranks.where("kind = 'trust'").select("host", F.col("rank").alias("trust")), "host", "left")
                  .join(ranks.where("kind = 'distrust'").select("host", F.col("rank").alias("distrust")), "host", "left")
                  .na.fill(0.0), "host-scores")
    bad = F.coalesce(F.col("distrust") - F.col("trust") > margin / n, F.lit(False))
    return (p.drop("html").join(hosts, "host", "left")
            .select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                    F.coalesce("fit.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
                    F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))

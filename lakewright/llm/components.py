"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import stage


def _to_smallest(edges: DataFrame, keep) -> DataFrame:
    """For every ``u``: links the kept ones of its neighbours to the smallest
    of ``u`` and its neighbours."""
    m = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(m, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (id, component_id): the smallest id reachable.

    Only ids on an edge are listed.  Each round is an aggregation with map-side
    combine and a join, written to the shared folder; rounds grow with the
    logarithm of the longest chain, and hubs are split by AQE's skew join.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both, F.col("v") > F.col("u")).where("u <> v").distinct()
        small = _to_smallest(large, F.lit(True)).unionByName(
            large.groupBy("u").agg(F.min("v").alias("v"))).where("u <> v").distinct()
        now = stage(small, "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return stars.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())

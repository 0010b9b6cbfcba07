"""Versioned reads over an append-only change log (V1-V5) and retention (M2).

A log holds one row per change: key column(s), payload, ``commit_id``,
``committed_at``, a tie-break column and optionally ``op`` ('D' = delete).
The state as of a version or a time is the latest row per key at or before
it, without the keys whose latest row is a delete.

Latest-per-key is an aggregate over (commit_id, committed_at, tie), see
``transform.latest_aggregate``: partial per map task, so one key holding a
third of the log costs one row per task in the shuffle, and two states can
be taken in one pass.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.functions.columns import minus_days, ts_literal
from lakewright.operators.transform import latest_aggregate, latest_per_key

DELETE_OP = "D"
DEFAULT_RETAIN_DAYS = 7


@dataclass(frozen=True)
class ChangeLog:
    """Column roles of a change log."""
    keys: tuple[str, ...]
    commit_id: str = "commit_id"
    committed_at: str = "committed_at"
    tie: str = "id"
    op: str | None = None

    def order_columns(self) -> list[str]:
        return [self.commit_id, self.committed_at, self.tie]


def _mark(version: int | None, timestamp: _dt.datetime | None, log: ChangeLog) -> Column:
    if version is None and timestamp is None:
        raise ValueError("give a version or a timestamp")
    if version is not None and timestamp is not None:
        raise ValueError("give a version or a timestamp, not both")
    if version is not None:
        return F.col(log.commit_id) <= F.lit(version)
    return F.col(log.committed_at) <= ts_literal(timestamp)


def latest_rows(df: DataFrame, log: ChangeLog, within: Column | None = None) -> DataFrame:
    """Latest row per key among rows where ``within`` holds (all rows if None)."""
    return latest_per_key(df, list(log.keys), log.order_columns(), within)


def state_as_of(df: DataFrame, log: ChangeLog, version: int | None = None,
                timestamp: _dt.datetime | None = None) -> DataFrame:
    """V1 (by commit id, inclusive) / V2 (by time, inclusive).

    Both arguments or neither is an error.  Snapshot 0 is a version like
    any other.  Keys whose latest row is a delete are absent.
    """
    within = _mark(version, timestamp, log)
    state = latest_rows(df.where(within), log)
    if log.op:
        state = state.where(~F.coalesce(F.col(log.op) == DELETE_OP, F.lit(False)))
    return state


def _commits(df: DataFrame, log: ChangeLog) -> DataFrame:
    """One row per commit (partial aggregate per task)."""
    return df.groupBy(log.commit_id).agg(
        F.max(log.committed_at).alias("committed_at"),
        F.count(F.lit(1)).alias("rows_changed")).withColumnRenamed(log.commit_id, "commit_id")


def _ordered_commit_scan(commits: DataFrame) -> DataFrame:
    """Previous/next commit and running row total, without one global window.

    Commits fall into ranges of ids.  The borders are drawn once, as
    quantiles, and become part of the plan, so that the range is a function of the
    commit id alone and every branch sees the same ranges, whatever is
    reused, retried or evaluated again.  Each range computes lag, lead and
    its running total with a window partitioned by the range; the rows at its
    edges are then completed from a per-range summary (one row per non-empty
    range, at most ``spark.sql.shuffle.partitions`` rows, so it is
    broadcast).  No task holds more than one range of commits.
    """
    spark = commits.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    cuts = commits.agg(F.percentile_approx("commit_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    borders = F.array(*[F.lit(b) for b in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    r = commits.withColumn("_seg", F.size(F.filter(borders, lambda b: b < F.col("commit_id"))))
    w = Window.partitionBy("_seg").orderBy("commit_id")
    local = r.select(
        "_seg", "commit_id", "committed_at", "rows_changed",
        F.lag("commit_id").over(w).alias("_prev"),
        F.lead("commit_id").over(w).alias("_next"),
        F.lead("committed_at").over(w).alias("_next_at"),
        F.sum("rows_changed").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"))
    seg = r.groupBy("_seg").agg(
        F.min("commit_id").alias("_first"), F.max("commit_id").alias("_last"),
        F.min_by("committed_at", "commit_id").alias("_first_at"),
        F.sum("rows_changed").alias("_total"))
    ws = Window.orderBy("_seg")                       # over ranges, not commits
    seg = seg.select(
        "_seg",
        F.lag("_last").over(ws).alias("_seg_prev"),
        F.lead("_first").over(ws).alias("_seg_next"),
        F.lead("_first_at").over(ws).alias("_seg_next_at"),
        F.coalesce(F.sum("_total").over(ws.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_offset"))
    j = local.join(F.broadcast(seg), "_seg")
    return j.select(
        "commit_id", "committed_at", "rows_changed",
        F.coalesce("_prev", "_seg_prev").alias("parent_id"),
        F.coalesce("_next", "_seg_next").alias("next_id"),
        F.when(F.col("_next").isNotNull(), F.col("_next_at")).otherwise(F.col("_seg_next_at")).alias("valid_to"),
        (F.col("_run") + F.col("_offset")).cast("bigint").alias("total_rows"))


def commit_list(df: DataFrame, log: ChangeLog) -> DataFrame:
    """V3: one row per commit with its time, row count and parent commit."""
    return _ordered_commit_scan(_commits(df, log)).select(
        "commit_id", "committed_at", "rows_changed", "parent_id")


def commit_history(df: DataFrame, log: ChangeLog) -> DataFrame:
    """V4: when each commit became current and until when; running row total."""
    return _ordered_commit_scan(_commits(df, log)).select(
        "commit_id", "parent_id",
        F.col("committed_at").alias("made_current_at"),
        "valid_to", "total_rows",
        F.col("next_id").isNull().alias("is_current"))


def state_diff(df: DataFrame, log: ChangeLog, t1: _dt.datetime, t2: _dt.datetime,
               compare: list[str] | None = None) -> DataFrame:
    """V5: changes between the states at ``t1`` and ``t2``: 'I', 'U', 'D'.

    Both states come from one scan and one shuffle: two conditional
    latest-row aggregates per key.  Columns compare NULL-safely.  Output:
    keys, ``change``, then ``old_<c>`` / ``new_<c>`` for each payload column.
    """
    payload_cols = [c for c in df.columns if c not in log.keys]
    compare = payload_cols if compare is None else compare
    at = F.col(log.committed_at)
    old_state, _ = latest_aggregate(df, list(log.keys), log.order_columns(), at <= ts_literal(t1))
    new_state, _ = latest_aggregate(df, list(log.keys), log.order_columns(), at <= ts_literal(t2))
    agg = (df.where(at <= ts_literal(max(t1, t2)))
           .groupBy(*log.keys).agg(old_state.alias("o"), new_state.alias("n")))
    if log.op:
        gone = lambda s: F.coalesce(F.col(f"{s}.{log.op}") == DELETE_OP, F.lit(False))
        agg = agg.select(*log.keys,
                         F.when(~gone("o"), F.col("o")).alias("o"),
                         F.when(~gone("n"), F.col("n")).alias("n"))
    same = reduce(lambda a, b: a & b,
                  [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in compare])
    change = (F.when(F.col("o").isNull() & F.col("n").isNotNull(), F.lit("I"))
              .when(F.col("o").isNotNull() & F.col("n").isNull(), F.lit("D"))
              .when(F.col("o").isNotNull() & F.col("n").isNotNull() & ~same, F.lit("U")))
    out = agg.select(*log.keys, change.alias("change"),
                     *[F.col(f"o.{c}").alias(f"old_{c}") for c in payload_cols],
                     *[F.col(f"n.{c}").alias(f"new_{c}") for c in payload_cols])
    return out.where(F.col("change").isNotNull())


def retention_cutoff(as_of: _dt.datetime, retain_days: int = DEFAULT_RETAIN_DAYS) -> _dt.datetime:
    """now - N days, computed once on the driver from a given ``as_of``."""
    return as_of - _dt.timedelta(days=retain_days)


def expire_log(df: DataFrame, log: ChangeLog, as_of: _dt.datetime,
               retain_days: int = DEFAULT_RETAIN_DAYS) -> DataFrame:
    """M2: drop versions older than ``as_of - retain_days`` days.

    Kept: every row after the cutoff, plus the latest row per key at or
    before it (the baseline), so the state as of any time >= cutoff is
    unchanged and the last version is always kept.  A baseline row that is
    a delete is dropped too: the key is absent either way.
    """
    at = F.col(log.committed_at)
    cutoff = minus_days(as_of, retain_days)
    recent = df.where((at > cutoff) | at.isNull())         # a row without a time is in no version: it stays
    baseline = latest_rows(df.where(at <= cutoff), log)
    if log.op:
        baseline = baseline.where(~F.coalesce(F.col(log.op) == DELETE_OP, F.lit(False)))
    return recent.unionByName(baseline)

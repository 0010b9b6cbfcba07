"""Invariants on the real test tables and a property test of the upsert
against a plain-Python model of MERGE (brute force on small inputs)."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakewright.operators.checks import verify_equal
from lakewright.operators.merge import upsert
from lakewright.operators.transform import dedup_latest
from lakewright.operators.versions import ChangeLog, state_as_of
from lakewright.sources.tables import read_incremental
from tests.conftest import SF_SMALL

LOG = ChangeLog(keys=("user_id",), commit_id="commit_id", committed_at="ts", tie="event_id")


def _log(spark):
    return (spark.read.parquet(f"{SF_SMALL}/events.parquet")
            .withColumn("commit_id", F.dayofmonth("ts").cast("bigint")))


def test_state_at_last_commit_is_newest_per_key(spark):
    log = _log(spark)
    last = log.agg(F.max("ts")).first()[0]
    a = state_as_of(log, LOG, timestamp=last)
    b = dedup_latest(log, ["user_id"], ["commit_id", "ts", "event_id"])
    assert verify_equal(a, b).first().equal


def test_incremental_slices_partition_the_table(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    marks = [dt.datetime(2023, 12, 31)] + [dt.datetime(2024, 1, d, 7, 30, 0, 123456) for d in (5, 12, 20, 28)]
    parts = None
    for lo, hi in zip(marks, marks[1:] + [dt.datetime(2100, 1, 1)]):
        sl = read_incremental(ev, "ts", lo).where(F.col("ts") <= F.lit(hi.isoformat(sep=" ")).cast("timestamp_ntz"))
        parts = sl if parts is None else parts.unionByName(sl)
    assert verify_equal(parts, ev.where(F.col("ts").isNotNull())).first().equal


def _model(target, source, update_cols):
    """MERGE on key k (NULL never matches), source rows (k, a, b)."""
    src_by_key = {r[0]: r for r in source if r[0] is not None}
    out, matched = [], set()
    for t in target:
        s = src_by_key.get(t[0]) if t[0] is not None else None
        if s is None:
            out.append(t)
        else:
            matched.add(t[0])
            out.append(tuple(s[i] if name in update_cols else t[i] for i, name in enumerate("kab")))
    for s in source:
        if s[0] is None or s[0] not in matched:
            out.append(s)
    return sorted(out, key=repr)


rows = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.sampled_from(["x", "y", None]),
                          st.integers(0, 3)), max_size=8)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(target=rows, source=rows, subset=st.booleans(), bound=st.sampled_from([0, 1000]))
def test_upsert_matches_model(spark, target, source, subset, bound):
    # MERGE needs at most one source row per non-NULL key.
    seen, src = set(), []
    for r in source:
        if r[0] is None or r[0] not in seen:
            src.append(r)
            seen.add(r[0])
    schema = "k int, a string, b int"
    t = spark.createDataFrame(target, schema)
    s = spark.createDataFrame(src, schema)
    cols = ["k", "a"] if subset else ["k", "a", "b"]
    got = sorted((tuple(r) for r in upsert(t, s, "k", update_columns=cols, max_broadcast_rows=bound).collect()),
                 key=repr)
    assert got == _model(target, src, cols)


# --- versioned reads against a plain-Python model --------------------------

from lakewright.operators.versions import expire_log, state_diff  # noqa: E402

VLOG = ChangeLog(keys=("k",), commit_id="c", committed_at="at", tie="id", op="op")
VSCHEMA = "k int, v string, c bigint, at timestamp_ntz, id int, op string"
BASE = dt.datetime(2024, 1, 1)


def _state_model(rows, t):
    best = {}
    for r in rows:
        k, v, c, at, i, op = r
        if at <= t and (k not in best or (c, at, i) > best[k][:3]):
            best[k] = (c, at, i, v, op)
    return {k: b[3] for k, b in best.items() if b[4] != "D"}


logs = st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["a", "b", None]), st.integers(0, 4),
                          st.sampled_from(["U", "U", "D"])), max_size=12)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(entries=logs, t_hours=st.integers(0, 130), days=st.integers(0, 5))
def test_versions_match_model(spark, entries, t_hours, days):
    rows = [(k, v, c, BASE + dt.timedelta(days=c, minutes=i), i, op)
            for i, (k, v, c, op) in enumerate(entries)]
    df = spark.createDataFrame(rows, VSCHEMA)
    t = BASE + dt.timedelta(hours=t_hours)
    assert {r.k: r.v for r in state_as_of(df, VLOG, timestamp=t).collect()} == _state_model(rows, t)
    # retention keeps the state at and after its cutoff
    asof = BASE + dt.timedelta(days=5)
    kept = [tuple(r) for r in expire_log(df, VLOG, asof, days).collect()]
    cutoff = asof - dt.timedelta(days=days)
    for when in (cutoff, cutoff + dt.timedelta(hours=30), BASE + dt.timedelta(days=9)):
        assert _state_model(kept, when) == _state_model(rows, when)
    # state diff between the cutoff and the end
    t2 = BASE + dt.timedelta(days=9)
    a, b = _state_model(rows, t), _state_model(rows, t2)
    want = {k: "I" for k in b if k not in a}
    want.update({k: "D" for k in a if k not in b})
    got = {r.k: r.change for r in state_diff(df, VLOG, t, t2).collect()}
    # 'U' whenever the newest row differs; the model compares rows, not values
    changed = {r.k for r in state_diff(df, VLOG, t, t2).collect() if r.change == "U"}
    assert {k: c for k, c in got.items() if c != "U"} == want
    assert changed <= {k for k in a if k in b}

import datetime as dt

import pytest

from lakewright.operators.checks import verify_equal
from lakewright.operators.versions import (
    ChangeLog, commit_history, commit_list, expire_log, state_as_of, state_diff,
)

D = dt.datetime
LOG = ChangeLog(keys=("k",), commit_id="c", committed_at="at", tie="id", op="op")
SCHEMA = "k int, v string, c bigint, at timestamp_ntz, id int, op string"


def log_df(spark):
    return spark.createDataFrame([
        (1, "a0", 0, D(2024, 1, 1, 0, 0, 0, 1), 1, "U"),
        (2, "b0", 0, D(2024, 1, 1, 0, 0, 0, 2), 2, "U"),
        (1, "a1", 1, D(2024, 1, 2), 3, "U"),
        (2, None, 1, D(2024, 1, 2), 4, "D"),         # delete
        (2, "b2", 2, D(2024, 1, 3), 5, "U"),         # re-insert
        (3, "c2", 2, D(2024, 1, 3), 6, "U"),
        (3, "c2x", 2, D(2024, 1, 3), 7, "U"),        # same time: higher id wins
    ], SCHEMA)


def state(df):
    return {r.k: r.v for r in df.collect()}


def test_version_and_time(spark):
    df = log_df(spark)
    assert state(state_as_of(df, LOG, version=0)) == {1: "a0", 2: "b0"}   # snapshot 0 is valid
    assert state(state_as_of(df, LOG, version=1)) == {1: "a1"}
    assert state(state_as_of(df, LOG, version=2)) == {1: "a1", 2: "b2", 3: "c2x"}
    assert state(state_as_of(df, LOG, timestamp=D(2024, 1, 1, 0, 0, 0, 1))) == {1: "a0"}
    assert state(state_as_of(df, LOG, timestamp=D(2030, 1, 1))) == {1: "a1", 2: "b2", 3: "c2x"}


def test_arguments(spark):
    df = log_df(spark)
    with pytest.raises(ValueError):
        state_as_of(df, LOG)
    with pytest.raises(ValueError):
        state_as_of(df, LOG, version=1, timestamp=D(2024, 1, 1))


def test_commits_and_history(spark):
    df = log_df(spark)
    cl = [tuple(r) for r in commit_list(df, LOG).orderBy("commit_id").collect()]
    assert [(c, n, p) for c, _, n, p in cl] == [(0, 2, None), (1, 2, 0), (2, 3, 1)]
    h = commit_history(df, LOG).orderBy("commit_id").collect()
    assert [r.total_rows for r in h] == [2, 4, 7]
    assert [r.is_current for r in h] == [False, False, True]
    assert h[0].valid_to == h[1].made_current_at


def test_state_diff(spark):
    df = log_df(spark)
    d = {r.k: r.change for r in state_diff(df, LOG, D(2024, 1, 1, 12), D(2024, 1, 2, 12)).collect()}
    assert d == {1: "U", 2: "D"}
    d = {r.k: r.change for r in state_diff(df, LOG, D(2024, 1, 2, 12), D(2024, 1, 3, 12)).collect()}
    assert d == {2: "I", 3: "I"}
    assert state_diff(df, LOG, D(2024, 1, 3), D(2024, 1, 3)).count() == 0


def test_expire_keeps_state_after_cutoff(spark):
    df = log_df(spark)
    asof = D(2024, 1, 4)
    for days in (0, 1, 2, 3, 10):
        kept = expire_log(df, LOG, asof, retain_days=days)
        cutoff = asof - dt.timedelta(days=days)
        for t in (cutoff, cutoff + dt.timedelta(hours=12), D(2024, 2, 1)):
            v = verify_equal(state_as_of(df, LOG, timestamp=t),
                             state_as_of(kept, LOG, timestamp=t)).first()
            assert v.equal, (days, t)
    # cutoff after the last commit keeps exactly the latest row of each live key
    assert state(expire_log(df, LOG, D(2030, 1, 1), 1)) == {1: "a1", 2: "b2", 3: "c2x"}


def test_empty_log(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert state_as_of(empty, LOG, version=3).count() == 0
    assert expire_log(empty, LOG, D(2024, 1, 1)).count() == 0


def test_commit_scan_across_many_ranges_matches_global_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    import random
    rnd = random.Random(7)
    ids = sorted(rnd.sample(range(10, 10_000_000), 300))
    rows = []
    for n, c in enumerate(ids):
        for j in range(rnd.randint(1, 4)):
            rows.append((n % 17, f"v{n}", c, D(2024, 1, 1) + dt.timedelta(minutes=n, seconds=j), n * 10 + j, "U"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = commit_history(df, LOG).orderBy("commit_id").collect()
    commits = df.groupBy("c").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("c")
    want = commits.select("c", F.lag("c").over(w).alias("p"), F.lead("at").over(w).alias("v"),
                          F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("t"),
                          F.lead("c").over(w).isNull().alias("cur")).orderBy("c").collect()
    assert [(r.commit_id, r.parent_id, r.valid_to, r.total_rows, r.is_current) for r in got] == \
        [(r.c, r.p, r.v, r.t, r.cur) for r in want]

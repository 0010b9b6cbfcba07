"""Stored changes that a driver leaves at any step, taken up by a later one."""

import datetime as dt
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lakewright.operators import maintenance, stored_log
from lakewright.operators.checks import verify_equal
from lakewright.operators.versions import ChangeLog, expire_log, state_as_of
from lakewright.sinks import writers
from lakewright.sources.files import file_inventory

T0 = dt.datetime(2024, 1, 1)


class Lost(Exception):
    pass


def fails_at(monkeypatch, step, *places):
    """The call number ``step`` of the named functions raises instead of working."""
    calls = []
    for module, name in places:
        def broken(*a, _real=getattr(module, name), **k):
            calls.append(1)
            if len(calls) == step + 1:
                raise Lost
            return _real(*a, **k)
        monkeypatch.setattr(module, name, broken)


def at_every_step(spark, monkeypatch, places, prepare, change, check, stride=1):
    """Run ``change`` stopped before each step, then again in a new session with
    another checkpoint folder; ``check`` holds in between and afterwards."""
    for step in range(0, 200, stride):
        state = prepare(step)
        with monkeypatch.context() as m:
            fails_at(m, step, *places)
            try:
                change(spark, state)
                over = True
            except Lost:
                over = False
        later = spark.newSession()
        for k in ("spark.sql.session.timeZone", "spark.sql.sources.partitionColumnTypeInference.enabled", "spark.sql.shuffle.partitions"):
            later.conf.set(k, spark.conf.get(k))
        check(later, state, over)
        change(later, state)
        check(later, state, True)
        if over:
            return step
    raise AssertionError("never came to its end")


def test_merge_stopped_at_every_step(spark, tmp_path, monkeypatch):
    start = spark.createDataFrame([(i, "abc"[i % 3] if i else "lone", i) for i in range(100)], "k int, p string, v int")
    batch = spark.createDataFrame([(0, "a", -1), (5, "new", -5), (200, "b", 2)], "k int, p string, v int")
    want = sorted([(i, "abc"[i % 3], i) for i in range(1, 100) if i != 5] + [(0, "a", -1), (5, "new", -5), (200, "b", 2)])

    def prepare(step):
        path = str(tmp_path / f"t{step}")
        writers.write_table(start, path, "overwrite", ["p"])
        return path

    def change(session, path):
        again = session.createDataFrame(batch.collect(), batch.schema)
        writers.merge_into_path(again, path, ["k"], ["p"])

    def check(session, path, done):
        if done:
            rows = session.read.schema(start.schema).parquet(path).select("k", "p", "v").collect()
            assert sorted(map(tuple, rows)) == want
            assert not os.path.exists(path + "_pending") and not os.path.exists(path + "/p=lone")
    steps = at_every_step(spark, monkeypatch, [(writers, "write_table"), (writers, "_delete_path"), (writers, "seal_change")], prepare, change, check)
    assert steps >= 6


_APPLICATION = """
import os, sys
sys.path.insert(0, {repo!r})
from lakewright.session import get_session
from lakewright.sinks import writers
spark = get_session("local[2]", extra={{"spark.sql.shuffle.partitions": "2"}})
path, die = sys.argv[1], sys.argv[2] == "die"
if die:
    writers.write_table(spark.createDataFrame([(i, "lone" if i == 0 else "b", i) for i in range(100)], "k int, p string, v int"), path, "overwrite", ["p"])
    real = writers._delete_path
    def lost(s, where):
        if where.startswith(path + "/"):
            os._exit(3)
        real(s, where)
    writers._delete_path = lost
writers.merge_into_path(spark.createDataFrame([(0, "b", -1)], "k int, p string, v int"), path, ["k"], ["p"])
rows = spark.read.parquet(path).collect()
print("ROWS", len(rows), len({{r.k for r in rows}}))
"""


def test_merge_of_a_killed_application_is_finished_by_the_next(tmp_path):
    path = str(tmp_path / "t")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "app.py"
    script.write_text(_APPLICATION.format(repo=repo))
    run = lambda how: subprocess.run([sys.executable, str(script), path, how], capture_output=True, text=True, timeout=300)
    assert run("die").returncode == 3
    assert os.path.isdir(path + "/p=lone")                        # the target is written, the emptied folder still there
    again = run("go on")
    assert "ROWS 100 100" in again.stdout, again.stdout + again.stderr[-2000:]


def test_append_once_stopped_at_every_step(spark, tmp_path, monkeypatch):
    rows = [(i, str(i % 2)) for i in range(10)]

    def prepare(step):
        path = str(tmp_path / f"t{step}")
        writers.write_table(spark.createDataFrame(rows[:4], "k int, p string"), path, "append", ["p"])
        return path

    def change(session, path):
        assert writers.append_once(session.createDataFrame(rows[4:], "k int, p string"), path, "run 2", ["p"]) == 6

    def check(session, path, done):
        if done:
            back = session.read.schema("k int, p string").parquet(path).select("k", "p").collect()
            assert sorted(map(tuple, back)) == rows
    at_every_step(spark, monkeypatch, [(writers, "write_table"), (writers, "_data_files"), (writers, "_delete_path")], prepare, change, check)


def test_append_once_to_a_table_that_is_not_there(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a")], "k int, p string")
    assert [writers.append_once(df, path, "1", ["p"]) for _ in range(2)] == [1, 1]
    assert writers.append_once(df, path, "2", ["p"]) == 1
    assert spark.read.parquet(path).count() == 2


def test_compaction_follows_its_plan_and_survives(spark, tmp_path, monkeypatch):
    def prepare(step):
        path = str(tmp_path / f"t{step}")
        df = spark.range(3000).select("id", F.concat(F.lit("x" * 50), F.col("id").cast("string")).alias("s"),
                                      (F.col("id") % 3).cast("string").alias("p"))
        df.where("p <> '2'").repartition(6).write.partitionBy("p").parquet(path)
        df.where("p = '2'").coalesce(1).write.mode("append").partitionBy("p").parquet(path)
        df.where("id < 2").select("id", "s", F.lit(None).cast("string").alias("p")).repartition(2).write.mode("append").partitionBy("p").parquet(path)
        return path, {r["file_path"] for r in file_inventory(spark.read.parquet(path), ["p"]).where("p = '2'").collect()}

    def change(session, state):
        plans[state[0]] = plans.get(state[0]) or maintenance.rewrite_groups(
            file_inventory(spark.read.parquet(state[0]), ["p"]), ["p"], 20_000).collect()
        maintenance.compact_table(session, state[0], ["p"], 20_000)

    def check(session, state, done):
        table = session.read.parquet(state[0])
        if done:
            files = file_inventory(table, ["p"]).collect()
            for p in ("0", "1", None):
                plan = [r for r in plans[state[0]] if r["p"] == p]
                assert len(plan) > plan[0]["target_files"] == len([r for r in files if r["p"] == p])
            assert {r["file_path"] for r in files if r["p"] == "2"} == state[1]
            assert table.agg(F.count("*"), F.sum("id"), F.countDistinct("s")).first()[:] == (3002, 4498501, 3000)
    plans = {}
    steps = at_every_step(spark, monkeypatch, [(maintenance, "seal_change"), (writers, "write_table")], prepare, change, check)
    assert steps >= 2


def test_compaction_without_partitions_and_of_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(5).write.parquet(path)
    r = maintenance.compact_table(spark, path, []).first()
    assert (r["files"], r["target_files"], r["needs_rewrite"]) == (5, 1, True)
    assert len(spark.read.parquet(path).inputFiles()) == 1 and spark.read.parquet(path).count() == 100
    assert not maintenance.compact_table(spark, path, []).first()["needs_rewrite"]


LOG = ChangeLog(keys=("k",), commit_id="c", committed_at="at", tie="t", op="op")
KINDS = "k int, c long, at timestamp_ntz, t int, op string, v int"


def changes(seed, n=300, commits=20):
    draw = random.Random(seed)
    return [(draw.randrange(12) if draw.random() > 0.05 else None, c, None if draw.random() < 0.02 else T0 + dt.timedelta(hours=24 * c + draw.randrange(-9, 30), microseconds=i),
             i, "D" if draw.random() < 0.15 else "U", i) for i in range(n) for c in [draw.randrange(commits)]]


@pytest.mark.parametrize("seed", [1, 2])
def test_stored_log_reads_as_the_whole_log(spark, tmp_path, seed):
    df, root = spark.createDataFrame(changes(seed), KINDS), str(tmp_path / "log")
    stored_log.write_commits(df, root, LOG)
    for version in (4, 11):
        stored_log.write_baseline(spark, root, LOG, version)
    for how in [{"version": v} for v in (0, 4, 10, 11, 15, 30)] + [{"timestamp": T0 + dt.timedelta(days=d, hours=7)} for d in (-3, 3, 8, 13, 40)]:
        got = stored_log.read_as_of(spark, root, LOG, **how).select(*df.columns)
        assert verify_equal(state_as_of(df, LOG, **how), got).first()["equal"], how


def test_only_the_baseline_and_later_commits_are_listed(spark, tmp_path):
    df, root = spark.createDataFrame([r for r in changes(3) if r[2]], KINDS), str(tmp_path / "log")
    stored_log.write_commits(df, root, LOG)
    stored_log.write_baseline(spark, root, LOG, 10)
    folders = lambda d: {os.path.basename(os.path.dirname(f)) for f in d.inputFiles()}
    assert folders(stored_log.read_as_of(spark, root, LOG, version=13)) == {"baseline=snapshot-10", "commit_id=11", "commit_id=12", "commit_id=13"}
    late = folders(stored_log.read_as_of(spark, root, LOG, timestamp=T0 + dt.timedelta(days=15)))
    assert "baseline=snapshot-10" in late and not late & {f"commit_id={c}" for c in (*range(11), 17, 18, 19)}
    with pytest.raises(ValueError):
        stored_log.read_as_of(spark, root, LOG)
    with pytest.raises(ValueError):
        stored_log.write_commits(spark.createDataFrame([(1, None, T0, 1, "U", 1)], KINDS), root, LOG)


def test_retention_on_storage_stopped_at_every_step(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(changes(4, 60, 4), KINDS).coalesce(1).cache()
    as_of, cutoff = T0 + dt.timedelta(days=9), T0 + dt.timedelta(days=2)
    marks = [{"timestamp": cutoff}, {"version": 30}]
    want = [sorted(map(str, state_as_of(df, LOG, **m).select(*df.columns).collect())) for m in marks]
    kept = sorted(map(str, expire_log(df, LOG, as_of, 7).collect()))
    first = str(tmp_path / "first")
    stored_log.write_commits(df, first, LOG)
    stored_log.write_baseline(spark, first, LOG, 0)

    def prepare(step):
        root = str(tmp_path / f"log{step}")
        subprocess.run(["cp", "-r", first, root], check=True)
        return root

    def change(session, root):
        stored_log.expire_stored(session, root, LOG, as_of, 7)

    def check(session, root, done):
        got = [sorted(map(str, stored_log.read_as_of(session, root, LOG, **m).select(*df.columns).collect())) for m in marks]
        assert got == want
        if done:
            assert sorted(map(str, stored_log.read_log(session, root, LOG).select(*df.columns).collect())) == kept
            assert not os.path.exists(root + "/baselines/baseline=snapshot-0")
    at_every_step(spark, monkeypatch, [(stored_log, "write_table"), (stored_log, "_delete_path")], prepare, change, check, stride=3)


def test_observed_write_reads_its_source_once_and_sees_microseconds(spark, tmp_path):
    nested = "a struct<at:timestamp_ntz>, b array<map<string,int>>"
    one = spark.createDataFrame([((dt.datetime(2024, 1, 1, 0, 0, 0, 1),), [{"x": 1, "y": 2}])], nested)
    two = spark.createDataFrame([((dt.datetime(2024, 1, 1, 0, 0, 0, 2),), [{"x": 1, "y": 2}])], nested)
    assert not verify_equal(one, two, method="fingerprint").first()["equal"]
    assert verify_equal(one, one, method="fingerprint").first()["equal"]
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        runs.add(1)
        yield from batches
    source = spark.range(0, 1000, 1, 1).selectExpr("id", "cast(id as string) s").mapInArrow(counted, "id long, s string")
    for fmt in ("parquet", "json", "csv"):
        before = runs.value
        r = writers.write_verified(source, str(tmp_path / fmt), fmt, method="observed").first()
        assert (r["left_rows"], r["right_rows"], r["equal"]) == (1000, 1000, True) and runs.value == before + 1
    part = spark.createDataFrame([("a",), ("b\nc",)], "v string")       # a line break makes two rows of one
    assert not writers.write_verified(part, str(tmp_path / "t"), "text", method="observed").first()["equal"]

"""Defects that were found once and must not return."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lakewright.diagnostics import access_diagnostics
from lakewright.operators import checks as C
from lakewright.operators.versions import ChangeLog, commit_history, commit_list, expire_log
from lakewright.streaming.incremental import incremental_load

LOG = ChangeLog(keys=("k",), commit_id="commit_id", committed_at="ts", tie="k")


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_commit_scan_is_the_same_however_it_is_evaluated(spark, reuse):
    n = 1_000_000
    log = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 3).alias("commit_id"),
                                F.timestamp_seconds(F.col("id")).alias("ts"))
    old = spark.conf.get("spark.sql.exchange.reuse", "true")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        parent = F.when(F.col("commit_id") > 0, F.col("commit_id") - 3)
        assert commit_list(log, LOG).where(~F.col("parent_id").eqNullSafe(parent)).count() == 0
        bad = commit_history(log, LOG).where(~F.col("parent_id").eqNullSafe(parent)
                                             | (F.col("total_rows") != F.col("commit_id") / 3 + 1))
        assert bad.count() == 0 and commit_history(log, LOG).where("is_current").count() == 1
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)


@pytest.mark.parametrize("method", ["exact", "fingerprint"])
def test_a_null_that_moves_between_columns_is_a_difference(spark, method):
    a = spark.createDataFrame([(None, "x")], "a string, b string")
    b = spark.createDataFrame([("x", None)], "a string, b string")
    assert not C.verify_equal(a, b, method=method).first()["equal"]
    assert C.verify_equal(a, a, method=method).first()["equal"]
    with pytest.raises(ValueError, match="different types"):
        C.verify_equal(spark.range(1), spark.range(1).select(F.col("id").cast("int").alias("id")), method=method)


def _load(spark, tmp, **more):
    schema = StructType([StructField("id", LongType()), StructField("v", StringType()), StructField("p", StringType())])
    return incremental_load(spark, f"{tmp}/in", schema, f"{tmp}/table", merge_keys=["id"], partition_columns=["p"], **more)


def test_a_read_error_is_not_an_empty_table(spark, tmp):
    rows = spark.range(10).select("id", F.lit("a").alias("v"), F.lit("x").alias("p"))
    rows.coalesce(1).write.partitionBy("p").parquet(f"{tmp}/table")
    for f in os.listdir(f"{tmp}/table/p=x"):
        if f.endswith(".parquet"):
            with open(f"{tmp}/table/p=x/{f}", "r+b") as h:
                h.seek(20)
                h.write(b"\0" * 200)
    before = sorted(os.listdir(f"{tmp}/table/p=x"))
    spark.createDataFrame([(1, "b", "x")], "id long, v string, p string").write.parquet(f"{tmp}/in")
    with pytest.raises(Exception):
        _load(spark, tmp)
    assert sorted(os.listdir(f"{tmp}/table/p=x")) == before


def test_duplicate_keys_are_refused_by_an_empty_table_too(spark, tmp):
    spark.createDataFrame([(1, "a", "x"), (1, "b", "x")], "id long, v string, p string").write.parquet(f"{tmp}/in")
    with pytest.raises(Exception, match="several rows"):
        _load(spark, tmp)


def test_progress_is_found_again_without_a_given_checkpoint(spark, tmp):
    spark.createDataFrame([(i, "a", "x") for i in range(4)], "id long, v string, p string").write.parquet(f"{tmp}/in")
    assert _load(spark, tmp) == 1
    assert os.path.isdir(f"{tmp}/table_progress") and _load(spark, tmp) == 0
    assert spark.read.parquet(f"{tmp}/table").count() == 4


def test_an_unreadable_table_fails_alone(spark, tmp):
    spark.range(5).write.parquet(f"{tmp}/good")
    spark.range(5).coalesce(1).write.parquet(f"{tmp}/bad")
    for f in os.listdir(f"{tmp}/bad"):
        if f.endswith(".parquet"):
            with open(f"{tmp}/bad/{f}", "r+b") as h:
                h.write(b"\0" * 100)
    rows = access_diagnostics(spark, [f"{tmp}/good", f"{tmp}/bad"], "r").collect()
    assert {r["status"] for r in rows if r["table_name"].endswith("bad")} == {"FAIL"}
    assert {r["status"] for r in rows if r["table_name"].endswith("good")} == {"INFO"}


def test_read_access_reads_every_visible_column(spark, tmp):
    spark.range(5).select("id", F.lit("x").alias("a.b")).write.parquet(f"{tmp}/t")
    df = spark.read.parquet(f"{tmp}/t")
    plan = C.run_checks(df, "t", C.access_checks(df, df.columns), "r")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,a.b:string>" in plan


def test_retention_keeps_rows_without_a_time(spark):
    import datetime as dt
    log = ChangeLog(keys=("k",), commit_id="commit_id", committed_at="ts", tie="t")
    df = spark.createDataFrame([(1, 1, None, 0), (2, 2, dt.datetime(2024, 1, 1), 0)],
                               "k long, commit_id long, ts timestamp, t int")
    assert expire_log(df, log, dt.datetime(2024, 2, 1), 7).count() == 2


def test_merge_finishes_what_a_lost_driver_left(spark, tmp_path, monkeypatch):
    from lakewright.sinks import writers
    path, staging = str(tmp_path / "t"), str(tmp_path / "staging")
    start = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "k int, p string, v int")
    writers.write_table(start, path, "overwrite", ["p"])
    batch = spark.createDataFrame([(1, "b", 11)], "k int, p string, v int")
    real, calls = writers._delete_path, []

    def lost(s, where):
        calls.append(where)
        if where.startswith(path):                     # the target is written, its emptied folder still there
            raise RuntimeError("driver lost")
        real(s, where)
    monkeypatch.setattr(writers, "_delete_path", lost)
    with pytest.raises(RuntimeError):
        writers.merge_into_path(batch, path, ["k"], ["p"], staging_path=staging)
    assert calls[-1] == f"{path}/p=a"
    monkeypatch.setattr(writers, "_delete_path", real)
    for _ in range(2):
        writers.merge_into_path(batch, path, ["k"], ["p"], staging_path=staging)
        rows = spark.read.schema(start.schema).parquet(path).select("k", "p", "v").collect()
        assert sorted(map(tuple, rows)) == [(1, "b", 11), (2, "b", 20), (3, "c", 30)]
    assert not (tmp_path / "staging").exists()


def test_merge_without_partitions_survives_a_lost_target(spark, tmp_path, monkeypatch):
    from lakewright.sinks import writers
    path, staging = str(tmp_path / "t"), str(tmp_path / "staging")
    start = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    writers.write_table(start, path, "overwrite")
    real = writers._finish_merge
    monkeypatch.setattr(writers, "_finish_merge", lambda *a: None)
    writers.merge_into_path(start.where("k = 1").withColumn("v", F.lit(11)), path, ["k"], [], staging_path=staging)
    writers._delete_path(spark, path)                  # as if the driver died while the target was replaced
    monkeypatch.setattr(writers, "_finish_merge", real)
    writers.merge_into_path(start.where("k = 2").withColumn("v", F.lit(21)), path, ["k"], [], staging_path=staging)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 11), (2, 21)]


def test_fingerprint_of_nested_fields(spark):
    from lakewright.functions.columns import row_fingerprint
    df = spark.sql("""SELECT * FROM VALUES
        (1, named_struct('a', 'a, b', 'b', 'c'), array('x, y'), map('k', 1, 'l', 2)),
        (2, named_struct('a', 'a', 'b', 'b, c'), array('x, y'), map('k', 1, 'l', 2)),
        (3, named_struct('a', 'a', 'b', 'b, c'), array('x', 'y'), map('k', 1, 'l', 2)),
        (4, named_struct('a', 'a', 'b', 'b, c'), array('x', 'y'), map('l', 2, 'k', 1)),
        (5, named_struct('a', 'a', 'b', CAST(NULL AS STRING)), array('x', 'y'), map('l', 2, 'k', 1)),
        (6, NULL, array(), NULL), (7, NULL, NULL, NULL) AS t(id, s, a, m)""")
    fields = [(c, df.schema[c].dataType) for c in ("s", "a", "m")]
    got = {r["id"]: r["f"] for r in df.select("id", row_fingerprint(fields).alias("f")).collect()}
    assert got[3] == got[4] and len(set(got.values())) == 6


def test_column_audit_keeps_odd_names(spark):
    from lakewright.operators.governance import audit_columns
    df = spark.createDataFrame([(1, None, 3)], "a int, `#b` int, `c.d` int")
    rows = {r["column_name"]: (r["hidden"], r["values_visible"]) for r in audit_columns(df, df.drop("a"), "t").collect()}
    assert rows == {"a": (True, 0), "#b": (False, 0), "c.d": (False, 1)}

import pytest
from pyspark.sql import functions as F

from lakewright.operators.checks import (
    Check, access_checks, row_count, run_checks, run_report, status_rollup, top_n, verify_equal,
)


def test_check_statuses_and_rollup(spark):
    df = spark.createDataFrame([(1, -1.0), (2, 5.0), (None, 1.0)], "id int, v double")
    checks = access_checks(df, ["id", "v", "hidden"]) + [
        Check("id not null", F.count_if(F.col("id").isNull())),
        Check("v positive", F.count_if(F.col("v") <= 0), "WARNING"),
        Check("v finite", F.count_if(F.isnan("v"))),
    ]
    res = run_checks(df, "t", checks, "r1")
    st = {r.check_name: (r.status, r.observed) for r in res.collect()}
    assert st["hidden columns"] == ("INFO", 1)
    assert st["rows behind the row policy"] == ("INFO", 3)
    assert st["id not null"] == ("FAIL", 1)
    assert st["v positive"] == ("WARNING", 1)
    assert st["v finite"] == ("PASS", 0)
    empty = run_checks(df.limit(0), "t", checks, "r1")
    assert {r.status for r in empty.collect() if r.status != "INFO"} == {"SKIPPED"}
    roll = status_rollup(res.unionByName(empty)).first()
    assert (roll.total_checks, roll.passed, roll.failed, roll.warnings) == (12, 1, 1, 1)
    rep = run_report(res, "job", "2024-01-01T00:00:00", "1").first()
    assert rep.total_checks == 6 and len(rep.results) == 6
    assert [x.check_name for x in rep.results] == sorted(x.check_name for x in rep.results)


@pytest.mark.parametrize("method", ["exact", "fingerprint"])
def test_verify_equal(spark, method):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, None)], "i int, s string")
    b = spark.createDataFrame([("x", 1), (None, None), ("x", 1)], "s string, i int")
    assert verify_equal(a, b, method).first().equal
    c = spark.createDataFrame([(1, "x"), (None, None), (None, None)], "i int, s string")
    r = verify_equal(a, c, method).first()
    assert not r.equal
    if method == "exact":
        assert (r.left_only, r.right_only) == (1, 1)
    with pytest.raises(ValueError):
        verify_equal(a, a.select("i"))


def test_count_and_top_n(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 7)
    assert row_count(df).first().row_count == 100
    assert [r.id for r in top_n(df, 3, [F.col("g").desc(), F.col("id").desc()]).collect()] == [97, 90, 83]


def test_a_failing_check_becomes_a_row(spark):
    df = spark.createDataFrame([(1,)], "id int")
    res = run_checks(df, "t", [Check("ok", F.count_if(F.col("id").isNull())),
                               Check("hidden column", F.count_if(F.col("secret") > 0), "WARNING"),
                               Check("broken fail", F.count_if(F.col("nope").isNull()))], "r")
    st = {r.check_name: (r.status, r.message) for r in res.collect()}
    assert st["ok"][0] == "PASS"
    assert st["hidden column"][0] == "WARNING" and "UNRESOLVED_COLUMN" in st["hidden column"][1]
    assert st["broken fail"][0] == "FAIL"


@pytest.mark.parametrize("method", ["exact", "fingerprint"])
def test_verify_equal_with_map_columns(spark, method):
    a = spark.createDataFrame([(1, {"x": "1", "y": "2"})], "i int, m map<string,string>")
    b = spark.sql("SELECT 1 AS i, map('y', '2', 'x', '1') AS m")
    assert verify_equal(a, b, method).first().equal
    c = spark.sql("SELECT 1 AS i, map('y', '3', 'x', '1') AS m")
    assert not verify_equal(a, c, method).first().equal

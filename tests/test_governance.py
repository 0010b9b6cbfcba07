import pytest
from pyspark.sql import functions as F

from lakewright.operators.governance import (
    Policy, apply_column_policy, audit_columns, audit_rows, entitled_rows, governed_scan,
    read_requests, resolve_grants,
)
from lakewright.sources.tables import read_table_with_filter


def test_policy_before_user_filter(spark):
    df = spark.createDataFrame([(1, 5.0), (60, 9.0), (2, 9.0)], "user_id int, value double")
    out = read_table_with_filter(df, "value > 6", row_policy="user_id < 50")
    assert [r.user_id for r in out.collect()] == [2]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("user_id") < plan.index("value")


def test_columns_in_table_order_and_nested_refused(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "c int, a string, b double")
    assert apply_column_policy(df, allowed=["b", "c"]).columns == ["c", "b"]
    assert apply_column_policy(df, hidden=["a"]).columns == ["c", "b"]
    with pytest.raises(ValueError, match="nested"):
        apply_column_policy(df, allowed=["s.x"])
    out = governed_scan(df, Policy("p", row_filter="c > 0", hidden_columns=("a",)))
    assert out.columns == ["c", "b"] and out.count() == 1


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_entitled_rows_never_duplicates(spark, bound):
    t = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "n")], "k int, v string")
    ent = spark.createDataFrame([(1,), (1,), (3,), (None,)], "e int")
    out = entitled_rows(t, ent, [("k", "e")], max_broadcast_rows=bound)
    assert sorted(r.k for r in out.collect()) == [1, 3]


def test_grants(spark):
    reads = spark.createDataFrame([(1, "p1", "db", "t"), (2, "p2", "db", "t"), (3, "p3", "db", "t")],
                                  "request_id int, principal string, database_name string, table_name string")
    grants = spark.createDataFrame([
        ("p1", "db", "*", "DESCRIBE"), ("p1", "db", "t", "SELECT"), ("p1", "db", "t", "SELECT"),
        ("p2", "db", "*", "DESCRIBE"),                       # no SELECT: denied
        ("p3", "db", "t", "SELECT")],                       # no DESCRIBE on the database
        "principal string, database_name string, table_name string, permission string")
    allowed, denied = resolve_grants(read_requests(reads), grants)
    a = sorted((r.principal, r.permission) for r in allowed.collect())
    d = sorted((r.principal, r.permission) for r in denied.collect())
    assert a == [("p1", "DESCRIBE"), ("p1", "SELECT"), ("p2", "DESCRIBE"), ("p3", "SELECT")]
    assert d == [("p2", "SELECT"), ("p3", "DESCRIBE")]


def test_audits(spark):
    full = spark.createDataFrame([(1, "a", None), (2, None, 3.0)], "id int, s string, secret double")
    vis = apply_column_policy(full, hidden=["secret"])
    got = {r.column_name: (r.hidden, r.values_visible) for r in audit_columns(full, vis, "t").collect()}
    assert got == {"id": (False, 2), "s": (False, 1), "secret": (True, 0)}
    r = {x.principal: (x.visible_rows, x.total_rows, x.hidden_rows)
         for x in audit_rows(full, {"low": "id < 2", "all": "", "nulls": "s = 'a' OR s IS NULL AND false"}).collect()}
    assert r == {"low": (1, 2, 1), "all": (2, 2, 0), "nulls": (1, 2, 1)}


def test_row_policy_pushed_to_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = governed_scan(df, Policy("p", row_filter="user_id < 50"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), LessThan(user_id,50)]" in plan
    pruned = governed_scan(df, Policy("p", allowed_columns=("event_id",))).select(F.col("event_id"))
    assert "ReadSchema: struct<event_id:bigint>" in pruned._jdf.queryExecution().executedPlan().toString()

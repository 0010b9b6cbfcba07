import pytest
from pyspark.sql import functions as F

from lakewright.operators.merge import assert_unique_keys, duplicate_keys, upsert

T = "k int, a string, b int"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(params=["broadcast", "shuffle"])
def bound(request):
    # max_broadcast_rows=0 forces the full outer join path.
    return 1_000_000 if request.param == "broadcast" else 0


def test_update_insert_keep(spark, bound):
    t = spark.createDataFrame([(1, "t1", 10), (2, "t2", 20), (None, "tn", 0)], T)
    s = spark.createDataFrame([(2, "s2", 21), (3, "s3", 31), (None, "sn", 1)], T)
    out = upsert(t, s, "k", max_broadcast_rows=bound)
    assert rows(out, "k", "a", "b") == sorted(
        [(1, "t1", 10), (2, "s2", 21), (3, "s3", 31), (None, "tn", 0), (None, "sn", 1)], key=repr)


def test_update_subset_and_missing_source_column(spark, bound):
    t = spark.createDataFrame([(1, "t1", 10), (2, "t2", 20)], T)
    s = spark.createDataFrame([(2, "s2"), (3, "s3")], "k int, a string")
    out = upsert(t, s, "k", update_columns=["k"], max_broadcast_rows=bound)
    assert rows(out, "k", "a", "b") == [(1, "t1", 10), (2, "t2", 20), (3, "s3", None)]
    out = upsert(t, s, "k", max_broadcast_rows=bound)
    assert rows(out, "k", "a", "b") == [(1, "t1", 10), (2, "s2", 20), (3, "s3", None)]


def test_source_column_target_lacks_is_refused(spark):
    t = spark.createDataFrame([(1, "t1", 10)], T)
    s = spark.createDataFrame([(1, "x", 1, "extra")], "k int, a string, b int, c string")
    with pytest.raises(ValueError, match="target lacks"):
        upsert(t, s, "k")


def test_duplicate_source_keys_are_an_error(spark):
    t = spark.createDataFrame([(1, "t1", 10)], T)
    s = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], T)
    with pytest.raises(ValueError, match="several rows"):
        upsert(t, s, "k")
    assert duplicate_keys(s, "k").collect()[0]["n"] == 2
    # NULL keys never match, so two NULL-key source rows are not duplicates.
    assert_unique_keys(spark.createDataFrame([(None, "x", 1), (None, "y", 2)], T), "k")


def test_string_composite_key_refused(spark):
    t = spark.createDataFrame([(1, "t1", 10)], T)
    with pytest.raises(ValueError, match="list"):
        upsert(t, t, "k, a")


def test_composite_keys(spark, bound):
    t = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], T)
    s = spark.createDataFrame([(1, "y", 3), (2, "x", 4)], T)
    out = upsert(t, s, ["k", "a"], max_broadcast_rows=bound)
    assert rows(out, "k", "a", "b") == [(1, "x", 1), (1, "y", 3), (2, "x", 4)]


def test_deletes(spark, bound):
    t = spark.createDataFrame([(1, "t1", 10), (2, "t2", 20)], T)
    s = spark.createDataFrame([(1, "s1", 11, "D"), (3, "s3", 31, "D"), (4, "s4", 41, "U"),
                               (2, "s2", 21, None)], T + ", op string")
    out = upsert(t, s, "k", op_column="op", max_broadcast_rows=bound)
    assert rows(out, "k", "a", "b") == [(2, "s2", 21), (4, "s4", 41)]


def test_idempotent_and_empty_batch(spark, bound):
    t = spark.createDataFrame([(1, "t1", 10), (2, "t2", 20)], T)
    s = spark.createDataFrame([(2, "s2", 21), (3, "s3", 31)], T)
    once = upsert(t, s, "k", max_broadcast_rows=bound)
    twice = upsert(once, s, "k", max_broadcast_rows=bound)
    assert rows(once, "*") == rows(twice, "*")
    empty = spark.createDataFrame([], T)
    assert rows(upsert(t, empty, "k", max_broadcast_rows=bound), "*") == rows(t, "*")


def test_broadcast_path_does_not_shuffle_target(spark):
    t = spark.range(1000).select(F.col("id").cast("int").alias("k"), F.lit("t").alias("a"), F.lit(1).alias("b"))
    s = spark.createDataFrame([(5, "s", 2)], T)
    plan = upsert(t, s, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_shuffle_path_has_no_full_outer_join(spark):
    t = spark.range(1000).select(F.col("id").cast("int").alias("k"), F.lit("t").alias("a"), F.lit(1).alias("b"))
    s = spark.createDataFrame([(5, "s", 2), (5000, "n", 3)], T)
    out = upsert(t, s, "k", max_broadcast_rows=0)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan and "LeftOuter" in plan and "LeftAnti" in plan
    assert rows(out.where("k in (5, 5000)"), "k", "a", "b") == [(5, "s", 2), (5000, "n", 3)]

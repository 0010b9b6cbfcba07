import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, DecimalType, LongType, StringType, StructField, StructType, TimestampNTZType,
)

from lakewright.functions.columns import (
    minus_days, null_default, partition_columns, row_fingerprint, row_hash, sql_type,
)
from lakewright.operators.transform import (
    EVENT_TABLE_SCHEMA, conform_schema, dedup_latest, transform_events,
)

EV = StructType([
    StructField("id", LongType(), False), StructField("event_type", StringType()),
    StructField("user_id", StringType()), StructField("event_data", StringType()),
    StructField("event_timestamp", TimestampNTZType()),
])


def events(spark, rows):
    return spark.createDataFrame(rows, EV)


def test_partition_columns_unpadded_and_null(spark):
    df = events(spark, [(1, "a", "u", "{}", dt.datetime(2024, 3, 5, 1, 2, 3)),
                        (2, "a", "u", "{}", None)])
    out = df.select("id", *[c.alias(n) for n, c in partition_columns("event_timestamp").items()]).orderBy("id").collect()
    assert (out[0]["year"], out[0]["month"], out[0]["day"]) == ("2024", "3", "5")
    assert (out[1]["year"], out[1]["month"], out[1]["day"]) == (None, None, None)


def test_null_default_keeps_empty_string(spark):
    df = events(spark, [(1, None, "u", "{}", None), (2, "", "u", "{}", None), (3, "click", "u", "{}", None)])
    got = {r.id: r.t for r in df.select("id", null_default("event_type").alias("t")).collect()}
    assert got == {1: "unknown", 2: "", 3: "click"}


def test_row_hash_null_leaves_hash_unchanged(spark):
    one = spark.range(1).select(
        row_hash(F.lit(None).cast("bigint")).alias("a"),
        row_hash(F.lit(1).cast("bigint")).alias("b"),
        row_hash(F.lit(1).cast("bigint"), F.lit(None).cast("timestamp")).alias("c")).first()
    assert one.a == 42
    assert one.b == one.c


def test_transform_adds_columns_in_place(spark):
    asof = dt.datetime(2024, 2, 1)
    df = events(spark, [(7, None, "u", "{}", dt.datetime(2024, 1, 9, 10, 0, 0, 123456))])
    out = transform_events(df, as_of=asof)
    assert out.columns == ["id", "event_type", "user_id", "event_data", "event_timestamp",
                           "processed_at", "year", "month", "day", "row_hash"]
    r = out.first()
    assert r.event_type == "unknown" and r.day == "9" and r.processed_at == asof
    assert r.row_hash == df.select(F.hash("id", "event_timestamp")).first()[0]


def test_fingerprint_typed_null_safe_collision_safe(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("N", "x"), ("", "x")],
                               "p string, q string")
    fields = [("p", StringType()), ("q", StringType())]
    fps = [r.f for r in df.select(row_fingerprint(fields).alias("f")).collect()]
    assert len(set(fps)) == 5 and all(len(f) == 64 for f in fps)
    typed = spark.createDataFrame([(1, "1")], "a bigint, b string").select(
        row_fingerprint([("a", LongType())]).alias("x"),
        row_fingerprint([("b", StringType())]).alias("y")).first()
    assert typed.x != typed.y


def test_dedup_latest_newest_wins_and_ties(spark):
    df = spark.createDataFrame([
        (1, dt.datetime(2024, 1, 1), 10, "old"),
        (1, dt.datetime(2024, 1, 2), 11, "new"),
        (2, dt.datetime(2024, 1, 5), 20, "x"),
        (2, dt.datetime(2024, 1, 5), 21, "y"),     # tie on time: larger id wins
        (3, None, 30, "null-ts"),
        (3, dt.datetime(2020, 1, 1), 31, "dated"),  # NULL time loses
        (None, dt.datetime(2024, 1, 1), 40, "nullkey-a"),
        (None, dt.datetime(2024, 1, 3), 41, "nullkey-b"),
    ], "k int, ts timestamp_ntz, id int, v string")
    out = {r.k: r.v for r in dedup_latest(df, ["k"], ["ts", "id"]).collect()}
    assert out == {1: "new", 2: "y", 3: "dated", None: "nullkey-b"}


def test_dedup_plan_is_partial_aggregate(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("ts"))
    plan = dedup_latest(df, ["k"], ["ts"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan


def test_conform_refuses_extra_fills_missing(spark):
    df = events(spark, [(1, "a", "u", "{}", dt.datetime(2024, 1, 1))])
    out = conform_schema(df, EVENT_TABLE_SCHEMA)
    assert out.schema.names == EVENT_TABLE_SCHEMA.names
    assert out.schema["event_timestamp"].dataType.simpleString() == "timestamp_ntz"
    assert out.first().row_hash is None
    with pytest.raises(ValueError, match="not in the table schema"):
        conform_schema(df.withColumn("extra", F.lit(1)), EVENT_TABLE_SCHEMA)
    with pytest.raises(ValueError, match="non-nullable"):
        conform_schema(df.drop("id"), EVENT_TABLE_SCHEMA)


def test_conform_keeps_decimal_and_array(spark):
    schema = StructType([StructField("d", DecimalType(12, 2)), StructField("a", ArrayType(StringType()))])
    df = spark.createDataFrame([(Decimal("1.55"), ["x"])], schema)
    out = conform_schema(df, schema).first()
    assert out.d == Decimal("1.55") and out.a == ["x"]
    assert sql_type(DecimalType(12, 2)) == "decimal(12,2)"


def test_minus_days(spark):
    r = spark.range(1).select(minus_days(dt.datetime(2024, 1, 31), 7).alias("t")).first()
    assert r.t == dt.datetime(2024, 1, 24)


def test_dedup_latest_carries_map_columns(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1, map('a', 'x')), (1, 2, map('a', 'y')), (2, 1, map()) "
                   "AS t(k, ts, m)")
    out = {r.k: r.m for r in dedup_latest(df, ["k"], ["ts"]).collect()}
    assert out == {1: {"a": "y"}, 2: {}}

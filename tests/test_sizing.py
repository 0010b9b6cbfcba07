from pyspark.sql import functions as F

from lakewright.operators.sizing import fits_broadcast, measure


def test_measure_counts_rows_and_string_bytes(spark):
    df = spark.range(10).select(F.col("id"), F.repeat(F.lit("x"), 1000).alias("s"))
    rows, size = measure(df, 100)
    assert rows == 10
    assert 10 * 1000 < size < 10 * 1100          # 8 (long) + 1000 + overhead per row


def test_probe_counts_up_to_bound_plus_one(spark):
    big = spark.range(1_000_000)
    rows, _ = measure(big, 5)
    assert rows == 6
    assert not fits_broadcast(big, max_rows=5)


def test_byte_bound_refuses_few_wide_rows(spark):
    wide = spark.range(50).select(F.repeat(F.lit("y"), 100_000).alias("s"))
    assert fits_broadcast(wide, max_rows=1000, max_bytes=10_000_000)
    assert not fits_broadcast(wide, max_rows=1000, max_bytes=1_000_000)

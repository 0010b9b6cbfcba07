"""Broadcast only behind a proven size bound.

``measure(df, max_rows)`` runs one job over ``df``: every task counts its rows
and their byte size (fixed widths for fixed-width types plus the measured
length of every string, binary or nested value) and sends one row.  The job
reads the columns of the whole side once, so the probe costs what a scan of
the side costs; it is taken of sides that are expected to be small.
A side is broadcast only when both its row count
and its measured bytes are within bounds; beyond them the caller takes a
shuffle join (which AQE may still turn into a broadcast from runtime sizes).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType, BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType,
    IntegerType, LongType, ShortType, StringType, TimestampNTZType, TimestampType,
)

# Default bounds of a broadcast side.
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000
DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD_BYTES = 16

_FIXED = {BooleanType: 1, ByteType: 1, ShortType: 2, IntegerType: 4, DateType: 4, FloatType: 4,
          LongType: 8, DoubleType: 8, TimestampType: 8, TimestampNTZType: 8, DecimalType: 16}


def _value_bytes(name: str, dtype: DataType) -> Column | int:
    for t, width in _FIXED.items():
        if isinstance(dtype, t):
            return width
    c = F.col(name)
    if isinstance(dtype, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 8


def row_bytes(df: DataFrame) -> Column:
    """Approximate in-memory size of each row (fixed part + measured data)."""
    fixed = ROW_OVERHEAD_BYTES
    var: list[Column] = []
    for f in df.schema.fields:
        b = _value_bytes(f.name, f.dataType)
        if isinstance(b, int):
            fixed += b
        else:
            var.append(b)
    return reduce(lambda a, b: a + b, var, F.lit(fixed)).cast("bigint")


def measure(df: DataFrame, max_rows: int) -> tuple[int, int]:
    """(rows, bytes) of ``df``, the rows counted up to ``max_rows + 1``.

    One aggregate with partial sums in every task: a task sends one row.  A
    ``limit`` below it would send up to ``max_rows + 1`` rows of every task
    to a single one.
    """
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("b")).first()
    return min(int(r["n"]), max_rows + 1), int(r["b"])


def fits_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                   max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> bool:
    rows, size = measure(df, max_rows)
    return rows <= max_rows and size <= max_bytes


def broadcast_if_bounded(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                         max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``(broadcast(df), True)`` when both bounds hold, else ``(df, False)``."""
    if fits_broadcast(df, max_rows, max_bytes):
        return F.broadcast(df), True
    return df, False

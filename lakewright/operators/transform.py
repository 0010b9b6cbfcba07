"""Event transform (P1), dedup (P7) and schema conform."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType,
)

from lakewright.functions.columns import (
    null_default, partition_columns, processing_time, row_hash,
)

# The event table (fixed schema).  ``row_hash`` is part of the target: the
# transform adds it, so a target without it could not take the append.
# Timestamps are stored as TIMESTAMP_NTZ holding UTC wall time: the same
# values as a session-zone TIMESTAMP under a UTC session, but they read the
# same in any session zone and in any engine.
EVENT_SCHEMA = StructType([
    StructField("id", LongType(), False),
    StructField("event_type", StringType(), True),
    StructField("user_id", StringType(), True),
    StructField("event_data", StringType(), True),
    StructField("event_timestamp", TimestampNTZType(), True),
    StructField("processed_at", TimestampNTZType(), True),
    StructField("year", StringType(), True),
    StructField("month", StringType(), True),
    StructField("day", StringType(), True),
])
EVENT_TABLE_SCHEMA = StructType(EVENT_SCHEMA.fields + [StructField("row_hash", IntegerType(), True)])
EVENT_PARTITION_COLUMNS = ["year", "month", "day"]


def transform_events(df: DataFrame, as_of: _dt.datetime | None = None) -> DataFrame:
    """P1 = P2..P5 in one projection; input columns are kept in place.

    processing time, year/month/day strings from ``event_timestamp``,
    ``event_type`` NULL -> 'unknown', ``row_hash`` = hash(id, event_timestamp).
    """
    parts = partition_columns("event_timestamp")
    return df.withColumns({
        "processed_at": processing_time(as_of),
        "year": parts["year"],
        "month": parts["month"],
        "day": parts["day"],
        "event_type": null_default("event_type"),
        "row_hash": row_hash("id", "event_timestamp"),
    })


def _orderable(dtype) -> bool:
    from pyspark.sql.types import ArrayType, MapType, StructType
    if isinstance(dtype, MapType):
        return False
    if isinstance(dtype, ArrayType):
        return _orderable(dtype.elementType)
    if isinstance(dtype, StructType):
        return all(_orderable(f.dataType) for f in dtype.fields)
    return dtype.typeName() not in ("variant",)


def latest_aggregate(df: DataFrame, keys: list[str], order_by: list[str],
                     within: Column | None = None) -> tuple[Column, list[str]]:
    """The aggregate behind every latest-per-key operator, and the fields of
    the struct it returns (all non-key columns).

    ``max(struct(order..., rest...))`` when every column orders (one buffer
    per key), else ``max_by(row, struct(order..., orderable rest...))``.
    With ``within``, rows where it does not hold are ignored (the result is
    NULL for a key without such rows), so several states can be taken in
    one aggregation.
    """
    others = [c for c in df.columns if c not in keys and c not in order_by]
    rest = [c for c in others if _orderable(df.schema[c].dataType)]
    ranking = F.struct(*[F.col(c) for c in order_by + rest])
    if len(rest) == len(others):
        value = ranking if within is None else F.when(within, ranking)
        return F.max(value), order_by + rest
    fields = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in fields])
    return F.max_by(row, ranking if within is None else F.when(within, ranking)), fields


def latest_per_key(df: DataFrame, keys: list[str], order_by: list[str],
                   within: Column | None = None) -> DataFrame:
    """One row per key: the row with the greatest ``order_by`` (remaining
    orderable columns break ties), among rows where ``within`` holds."""
    agg, fields = latest_aggregate(df, keys, order_by, within)
    out = df.groupBy(*keys).agg(agg.alias("_w"))
    if within is not None:
        out = out.where(F.col("_w").isNotNull())
    return out.select(*[F.col(k) for k in keys],
                      *[F.col(f"_w.{c}").alias(c) for c in fields]).select(*df.columns)


def dedup_latest(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """One row per key; the greatest ``order_by`` wins, remaining
    (orderable) columns break ties, so the result does not depend on the
    plan.

    An aggregate, not a window: partial per map task, so a key that holds a
    third of all rows leaves each task as one row and no task sorts the hot
    key whole.  NULLs order lowest (as ``DESC NULLS LAST`` in a window).
    Map columns are carried along but cannot break ties.
    """
    return latest_per_key(df, keys, order_by)


def conform_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Make ``df`` match a declared table schema by name.

    Columns the table lacks are refused (``DataFrame.to`` would drop them
    silently); missing nullable columns become typed NULLs; a missing
    non-nullable column is refused.  Output is in table order with table
    types.
    """
    declared = {f.name: f for f in schema.fields}
    extra = [c for c in df.columns if c not in declared]
    if extra:
        raise ValueError(f"columns not in the table schema: {extra}")
    cols: list[Column] = []
    present = set(df.columns)
    for f in schema.fields:
        if f.name in present:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.nullable:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            raise ValueError(f"non-nullable column missing: {f.name}")
    return df.select(*cols)

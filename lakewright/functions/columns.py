"""Column expressions.  All are built-in Catalyst expressions (codegen'd,
JVM-side); none is a Python UDF.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, MapType, StructType, TimestampNTZType, TimestampType

# Fixed values that results depend on.
NULL_EVENT_TYPE_DEFAULT = "unknown"   # replaces a NULL event_type
ROW_HASH_SEED = 42                    # Murmur3 seed of Spark's hash()
FINGERPRINT_NULL = "N"                # marker for a NULL field in a fingerprint
FINGERPRINT_SEP = "|"                 # field separator in a fingerprint


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_literal(ts: _dt.datetime) -> Column:
    """A timestamp literal that does not depend on the Python process zone.

    A naive ``datetime`` means UTC wall time; an aware one is converted to
    UTC.  The literal is TIMESTAMP_NTZ; compared with a TIMESTAMP column it
    is read in the session zone (UTC), so both column kinds compare alike
    and the comparison with a bare column still reaches the parquet scan.
    """
    if ts.tzinfo is not None:
        ts = ts.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    return F.lit(ts.isoformat(sep=" ", timespec="microseconds")).cast("timestamp_ntz")


def processing_time(as_of: _dt.datetime | None = None) -> Column:
    """Processing time (UTC wall time), one value for the whole query.

    ``localtimestamp()`` is folded to one constant per query and, under the
    UTC session, is the current UTC time as TIMESTAMP_NTZ; passing ``as_of``
    makes the result repeatable (reruns, tests, oracles).
    """
    if as_of is None:
        return F.localtimestamp()
    return ts_literal(as_of)


def partition_columns(ts: str | Column) -> dict[str, Column]:
    """Year, month, day of month as unpadded strings ('1', not '01').

    A NULL timestamp gives NULL partition values.
    """
    t = _col(ts)
    return {
        "year": F.year(t).cast("string"),
        "month": F.month(t).cast("string"),
        "day": F.dayofmonth(t).cast("string"),
    }


def null_default(c: str | Column, default: str = NULL_EVENT_TYPE_DEFAULT) -> Column:
    """NULL -> ``default``; an empty string is kept as it is."""
    return F.coalesce(_col(c), F.lit(default))


def row_hash(*cols: str | Column) -> Column:
    """P5: 32-bit Murmur3 hash (seed 42) over the columns.

    A NULL input leaves the running hash unchanged.  Too narrow to dedup
    on at scale; see ``row_fingerprint``.
    """
    return F.hash(*[_col(c) for c in cols])


def _field_text(c: Column, dtype: DataType | None) -> Column:
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("string")
    if isinstance(dtype, DateType):
        return F.unix_date(c).cast("string")
    if isinstance(dtype, StructType):
        inner = [encoded(c.getField(f.name), f.dataType) for f in dtype.fields]
        return F.when(c.isNotNull(), F.concat_ws(FINGERPRINT_SEP, *inner))
    if isinstance(dtype, ArrayType):
        inner = F.transform(c, lambda x: encoded(x, dtype.elementType))
        return F.when(c.isNotNull(), F.concat_ws(FINGERPRINT_SEP, inner))
    if isinstance(dtype, MapType):            # entries in the order of their text: a map has none of its own
        inner = F.transform(F.map_entries(c), lambda e: F.concat_ws(
            FINGERPRINT_SEP, encoded(e["key"], dtype.keyType), encoded(e["value"], dtype.valueType)))
        return F.when(c.isNotNull(), F.concat_ws(FINGERPRINT_SEP, F.sort_array(inner)))
    return c.cast("string")


def encoded(col: Column, dtype: DataType | None) -> Column:
    """``<type>:<length>:<text>``, or ``<type>:N`` for NULL."""
    tag = dtype.simpleString() if dtype is not None else "string"
    text = _field_text(col, dtype)
    return F.coalesce(
        F.concat(F.lit(tag + ":"), F.length(text).cast("string"), F.lit(":"), text),
        F.lit(f"{tag}:{FINGERPRINT_NULL}"))


def row_fingerprint(fields: list[tuple[str | Column, DataType | None]]) -> Column:
    """SHA-256 row fingerprint for dedup: collision-safe, null-safe, typed.

    Each field is written as ``<type>:<length>:<text>`` (or ``<type>:N`` when
    NULL) and the fields are joined with ``|``.  The length prefix makes the
    encoding injective, so two different rows cannot produce the same input
    text, fields of nested values included (each is written the same way); the
    type name keeps ``1`` and ``'1'`` apart.  Timestamps are
    encoded as epoch microseconds, dates as epoch days.
    """
    parts = [encoded(_col(c), dtype) for c, dtype in fields]
    return F.sha2(F.concat_ws(FINGERPRINT_SEP, *parts), 256)


def minus_days(ts: Column | _dt.datetime, days: int) -> Column:
    """Timestamp minus ``INTERVAL n DAYS`` (constant-folded for literals)."""
    t = ts_literal(ts) if isinstance(ts, _dt.datetime) else ts
    return t - F.make_dt_interval(F.lit(days))


def sql_type(dtype: DataType) -> str:
    """DDL type name.  ``simpleString`` keeps decimal precision and
    nested types instead of collapsing them to STRING."""
    return dtype.simpleString()

"""Table scans: full, filtered, incremental, bounded sample.

A table is either a catalog name (``db.table``) or a path to a parquet
directory/file.  All scans stay lazy: predicates and column selections
reach the parquet reader as pushed filters and a pruned read schema.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions.columns import ts_literal


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """Full scan of all columns of a catalog table or a parquet path."""
    if "/" in table or table.endswith(".parquet"):
        return spark.read.parquet(table)
    return spark.table(table)


def _as_column(cond: str | Column) -> Column:
    return F.expr(cond) if isinstance(cond, str) else cond


def read_table_with_filter(df: DataFrame, condition: str | Column,
                           row_policy: str | Column | None = None) -> DataFrame:
    """Scan plus the caller's predicate.

    A policy row filter, when given, is applied first; Catalyst merges both
    into one conjunction with the policy on the left and pushes it down.
    """
    if row_policy is not None:
        df = df.where(_as_column(row_policy))
    return df.where(_as_column(condition))


def _coarse_partition_predicate(mark: _dt.datetime, year: str, month: str,
                                day: str) -> Column:
    """Partition-level predicate implied by ``ts > mark``.

    Partition values are unpadded strings, so they are compared as
    integers.  The predicate touches only partition columns, so Spark
    prunes directories with it; the exact row filter still follows.
    """
    y, m, d = (F.col(c).cast("int") for c in (year, month, day))
    return ((y > mark.year)
            | ((y == mark.year) & (m > mark.month))
            | ((y == mark.year) & (m == mark.month) & (d >= mark.day)))


def read_incremental(df: DataFrame, timestamp_column: str,
                     last_processed: _dt.datetime,
                     partition_columns: tuple[str, str, str] | None = None,
                     overlap: _dt.timedelta | None = None) -> DataFrame:
    """S3: rows with ``timestamp_column > last_processed`` (strictly).

    The mark keeps its microseconds (a mark cut to whole seconds would read
    the rest of that second again).  NULL timestamps never qualify.  With
    ``partition_columns=(year, month, day)`` a coarse partition predicate is
    added so that a partitioned table is pruned by directory as well.

    ``overlap`` re-reads that much time before the mark, to pick up late
    rows stamped at or just before it; the caller removes the rows it has
    already loaded (``dedup_latest`` or an upsert on the key).
    """
    if not isinstance(last_processed, _dt.datetime):
        raise TypeError("last_processed must be a datetime")
    if overlap is not None:
        last_processed = last_processed - overlap
    cond = F.col(timestamp_column) > ts_literal(last_processed)
    if partition_columns is not None:
        cond = _coarse_partition_predicate(last_processed, *partition_columns) & cond
    return df.where(cond)


def next_mark(df: DataFrame, timestamp_column: str) -> DataFrame:
    """The high-water mark for the next incremental read: ``max(ts)``.

    Returned as a one-row DataFrame; the aggregate is partial per task, so
    the driver receives one value.
    """
    return df.agg(F.max(timestamp_column).alias("next_mark"))


def sample_access(df: DataFrame, n: int, order_by: list[str] | None = None) -> DataFrame:
    """Bounded sample read that really reads every visible column.

    ``SELECT * LIMIT n`` followed by ``count()`` lets the optimizer prune
    every column (an empty read schema), so nothing would be read.  Here the
    sample rows are read whole and each column's non-NULL values counted.

    Without ``order_by`` (the access check): ``take(n)`` scans incrementally
    -- one split first, more only if needed -- so the cost is O(n) rows even
    on a very large table, and the n sampled rows (the sample itself, bounded)
    are summarised on the driver.  With ``order_by`` the first ``n`` rows in
    that order are used (deterministic, but a per-task top-n over the whole
    table).
    """
    cols = df.columns
    spark = df.sparkSession
    schema = ("rows_returned bigint, column_count int, columns_visible string, "
              "values_read bigint")
    if order_by is None:
        rows = df.take(n)
        values = sum(1 for r in rows for v in r if v is not None)
        return spark.createDataFrame([(len(rows), len(cols), ",".join(cols), values)], schema)
    sample = df.orderBy(*[F.col(c) for c in order_by]).limit(n)
    values_read = reduce(lambda a, b: a + b, [F.count(F.col(c)) for c in cols]) if cols else F.lit(0)
    return sample.agg(
        F.count(F.lit(1)).alias("rows_returned"),
        F.lit(len(cols)).alias("column_count"),
        F.lit(",".join(cols)).alias("columns_visible"),
        values_read.cast("bigint").alias("values_read"),
    )


def visible_schema(df: DataFrame):
    """The schema a principal sees.  Metadata only, no job runs."""
    return df.schema

"""The ETL job (L1): governed read -> count -> stop on empty -> transform ->
create target if missing -> append (or upsert) -> counts.

The row count comes from ``DataFrame.observe`` on the written data, so the
source is not scanned a second time only to count it.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakewright.operators.governance import Policy, governed_scan
from lakewright.operators.merge import duplicate_keys
from lakewright.operators.transform import (
    EVENT_PARTITION_COLUMNS, EVENT_TABLE_SCHEMA, conform_schema, transform_events,
)
from lakewright.operators.checks import sql_string
from lakewright.sinks.writers import append_once, create_table, merge_into_path, read_if_there, write_table


def etl_transform(df: DataFrame, as_of: _dt.datetime | None = None) -> DataFrame:
    """Transform and conform to the event table schema (no write)."""
    return conform_schema(transform_events(df, as_of=as_of), EVENT_TABLE_SCHEMA)


def read_target(spark: SparkSession, location: str) -> bool:
    """Whether the table's files hold a row."""
    df = read_if_there(spark, location)
    return df is not None and bool(df.take(1))


@dataclass
class EtlResult:
    rows_written: int
    skipped: bool
    target: str


def run_etl(spark: SparkSession, source: DataFrame, target_table: str, warehouse_path: str,
            policy: Policy | None = None, as_of: _dt.datetime | None = None,
            comment: str = "Event rows after policy and transform",
            mode: str = "append", merge_keys: list[str] | None = None,
            run_id: str | None = None) -> EtlResult:
    """L1.  ``source`` is the event table (X1 columns); ``policy`` is the
    principal's row/column policy.  Empty input stops before any write.

    ``mode="append"`` adds the rows; ``mode="merge"`` upserts them on
    ``merge_keys`` (default ``id``), rewriting only touched partitions.
    A rerun after a failure gives the same table in ``merge`` mode, and in
    ``append`` mode too when both runs carry the same ``run_id`` (see
    ``append_once``); without one an append adds its rows at every run.  All
    other steps find what is done already: the table, its partitions, a merge that
    a lost driver left sealed.
    """
    if mode not in ("append", "merge"):
        raise ValueError(f"mode is {mode!r}, but only 'append' and 'merge' exist")
    governed = governed_scan(source, policy) if policy else source
    if not governed.take(1):                    # stops at the first row found
        return EtlResult(0, True, target_table)
    location = f"{warehouse_path.rstrip('/')}/{target_table.replace('.', '/')}"
    create_table(spark, target_table, EVENT_TABLE_SCHEMA, location,
                 partition_columns=EVENT_PARTITION_COLUMNS, comment=comment)
    obs = Observation("etl")
    out = etl_transform(governed, as_of=as_of).observe(obs, F.count(F.lit(1)).alias("rows"))
    # Partition columns go last, as the catalog table orders them.
    cols = [c for c in out.columns if c not in EVENT_PARTITION_COLUMNS] + EVENT_PARTITION_COLUMNS
    once = mode == "append" and run_id is not None
    empty_target = not once and mode == "merge" and not read_target(spark, location)
    if mode == "merge" and empty_target:
        several = duplicate_keys(out, merge_keys or ["id"]).take(1)       # the same rule as in a merge
        if several:
            raise ValueError(f"source has several rows for one target key: {several[0]}")
    rows = None
    if once:
        rows = append_once(out.select(*cols), location, run_id, EVENT_PARTITION_COLUMNS)
    elif mode == "append" or empty_target:
        write_table(out.select(*cols), location, "append", EVENT_PARTITION_COLUMNS)
    else:
        touched = merge_into_path(out.select(*cols), location, merge_keys or ["id"],
                                  EVENT_PARTITION_COLUMNS)
        emptied = [r for r in touched.collect() if not r["kept"]]
        for r in emptied:                       # a NULL value is named as its folder is
            spec = ", ".join(f"{c} = {sql_string(r[c])}" if r[c] is not None else f"{c} = NULL" for c in EVENT_PARTITION_COLUMNS)
            spark.sql(f"ALTER TABLE {target_table} DROP IF EXISTS PARTITION ({spec})")
    spark.catalog.refreshTable(target_table)
    spark.sql(f"ALTER TABLE {target_table} RECOVER PARTITIONS")
    return EtlResult(int(obs.get["rows"]) if rows is None else rows, False, target_table)


def main(argv: list[str] | None = None) -> EtlResult:
    """``python -m lakewright.etl --source-table ... --target-table ... --warehouse-path ...``"""
    import argparse

    from lakewright.session import get_session
    from lakewright.sources.tables import read_table
    ap = argparse.ArgumentParser(description="Governed read -> transform -> event table.")
    ap.add_argument("--source-table", required=True, help="catalog name or parquet path (event columns)")
    ap.add_argument("--target-table", required=True, help="catalog name of the event table")
    ap.add_argument("--warehouse-path", required=True)
    ap.add_argument("--row-filter", default=None, help="policy predicate (SQL)")
    ap.add_argument("--mode", default="append", choices=["append", "merge"])
    ap.add_argument("--merge-keys", default="id")
    a = ap.parse_args(argv)
    spark = get_session()
    policy = Policy("etl", row_filter=a.row_filter) if a.row_filter else None
    res = run_etl(spark, read_table(spark, a.source_table), a.target_table, a.warehouse_path,
                  policy=policy, mode=a.mode, merge_keys=a.merge_keys.split(","))
    print(res)
    return res


if __name__ == "__main__":
    main()

"""The two check jobs as DataFrame jobs: access diagnostics over tables and
write diagnostics over storage paths, rolled up in one run report.

Each check yields one result row (``checks.RESULT_COLUMNS``); a failing
table or write becomes a FAIL row and the run goes on.  Results stay
DataFrames; only the final report (one row per run) is written.

    python -m lakewright.diagnostics --tables db.t1,db.t2 --output /reports \\
        [--write-path /scratch/diag] [--run-id r1] [--job-name checks]
"""

from __future__ import annotations

import argparse
import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators.checks import (
    FAIL, PASS, access_checks, run_checks, run_report,
)
from lakewright.operators.governance import Policy, governed_scan
from lakewright.sinks.writers import save_report, write_verified
from lakewright.sources.tables import read_table

RESULT_SCHEMA = ("run_id string, table_name string, check_name string, status string, "
                 "message string, observed bigint, details map<string,string>, "
                 "recommendation string")


def _condition(e: Exception) -> str:
    get = getattr(e, "getCondition", None)
    try:
        return (get() if callable(get) else None) or type(e).__name__
    except Exception:  # noqa: BLE001
        return type(e).__name__


def _row(spark: SparkSession, run_id: str, table: str, check: str, status: str, message: str,
         details: dict[str, str] | None = None, recommendation: str | None = None) -> DataFrame:
    """One literal result row (for a check that could not run a job)."""
    return spark.createDataFrame([(run_id, table, check, status, message, None, details or {},
                                   recommendation)], RESULT_SCHEMA)


def access_diagnostics(spark: SparkSession, tables: list[str], run_id: str,
                       policies: dict[str, Policy] | None = None) -> DataFrame:
    """Per table: read access, column filtering and row filtering checks in
    one aggregate pass over the governed view.  A table that cannot be read
    gives a FAIL row named by its error condition."""
    parts = []
    for name in tables:
        try:
            full = read_table(spark, name)
            pol = (policies or {}).get(name)
            visible = governed_scan(full, pol) if pol else full
            # Run here, inside the guard: a file that can't be read fails its own table only.
            rows = run_checks(visible, name, access_checks(visible, full.columns), run_id)
            parts.append(spark.createDataFrame(rows.collect(), rows.schema))          # one row a check
        except Exception as e:  # noqa: BLE001
            cond = _condition(e)
            hint = ("No table or path of this name: check the spelling" if "NOT_FOUND" in cond
                    else "Ask for a grant, or repair the table or its files")
            parts.append(_row(spark, run_id, name, "readable rows", FAIL,
                              f"Cannot read {name}: {cond}", {"error": cond}, hint))
    return reduce(DataFrame.unionByName, parts)


def write_diagnostics(df: DataFrame, base_path: str, run_id: str,
                      formats: tuple[str, ...] = ("json", "parquet", "csv")) -> DataFrame:
    """Verified round trips of ``df`` to ``<base_path>/<format>_<run_id>``:
    PASS when the data read back equals the data written (R1), FAIL when it
    differs or the write fails."""
    spark = df.sparkSession
    parts = []
    for fmt in formats:
        path = f"{base_path.rstrip('/')}/{fmt}_{run_id}"
        name = f"{fmt.upper()} Write"
        try:
            v = write_verified(df, path, fmt).first()
            ok = bool(v["equal"])
            parts.append(_row(spark, run_id, path, name, PASS if ok else FAIL,
                              f"wrote {v['left_rows']} rows, read back {v['right_rows']}",
                              {"rows_written": str(v["left_rows"]), "rows_verified": str(v["right_rows"])},
                              None if ok else "The data read back differs from the data written")
                         .withColumn("observed", F.lit(v["right_rows"]).cast("bigint")))
        except Exception as e:  # noqa: BLE001
            cond = _condition(e)
            parts.append(_row(spark, run_id, path, name, FAIL, f"Cannot write {fmt}: {cond}",
                              {"error": cond}, "The path must be writable for this job"))
    return reduce(DataFrame.unionByName, parts)


def run_diagnostics(spark: SparkSession, tables: list[str], run_id: str, job_name: str,
                    write_path: str | None = None,
                    policies: dict[str, Policy] | None = None) -> DataFrame:
    """All checks of one run, rolled up into the run report (one row)."""
    results = access_diagnostics(spark, tables, run_id, policies)
    for i, name in enumerate(tables if write_path else []):
        # Every table, whole: a sample could miss the row that doesn't survive.
        path = f"{write_path.rstrip('/')}/{i}"
        try:
            results = results.unionByName(write_diagnostics(read_table(spark, name), path, run_id))
        except Exception as e:  # noqa: BLE001
            results = results.unionByName(_row(spark, run_id, path, "Write Checks", FAIL,
                                               f"{name} could not be written for checking: {_condition(e)}"))
    return run_report(results, job_name, _dt.datetime.now(_dt.timezone.utc).isoformat(), spark.version)


def main(argv: list[str] | None = None) -> str:
    from lakewright.session import get_session
    ap = argparse.ArgumentParser(description="Run table access and write checks; write the report.")
    ap.add_argument("--tables", required=True, help="comma-separated catalog names or parquet paths")
    ap.add_argument("--output", required=True, help="folder for the report")
    ap.add_argument("--write-path", default=None, help="scratch folder for write round trips")
    ap.add_argument("--run-id", default=_dt.datetime.now(_dt.timezone.utc).strftime("run-%Y%m%d%H%M%S"))
    ap.add_argument("--job-name", default="lakewright-diagnostics")
    a = ap.parse_args(argv)
    spark = get_session()
    report = run_diagnostics(spark, [t for t in a.tables.split(",") if t], a.run_id, a.job_name,
                             a.write_path)
    path = save_report(report, a.output, prefix=a.job_name)
    print(path)
    return path


if __name__ == "__main__":
    main()

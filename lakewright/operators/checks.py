"""Counts, limits, verified equality, check tables and run reports
(A1-A4, R1-R4).

A check is an aggregate expression over one table (the number of rows that
violate it, or an informational value).  All checks of a table are
evaluated in ONE aggregate pass and unpivoted into result rows; results of
several tables are unioned; the run report rolls them up per run.  Only the
report row (bounded by the number of checks, not by data) is ever small
enough to collect.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from lakewright.functions.columns import encoded

# The five check statuses.
PASS = "PASS"
FAIL = "FAIL"
WARNING = "WARNING"
SKIPPED = "SKIPPED"
INFO = "INFO"

RESULT_COLUMNS = ["run_id", "table_name", "check_name", "status", "message",
                  "observed", "details", "recommendation"]


def row_count(df: DataFrame) -> DataFrame:
    """A1: global row count (partial count per task, one value to the driver)."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def top_n(df: DataFrame, n: int, order_by: list[Column | str]) -> DataFrame:
    """A3: first ``n`` rows in a total order (per-task top-n, merged once).

    The caller's order should end in a unique column so that ties cannot
    make the result depend on the plan.
    """
    return df.orderBy(*order_by).limit(n)


@dataclass(frozen=True)
class Check:
    """One check over one table.

    ``observed`` is an aggregate expression.  For a FAIL/WARNING check it
    counts violating rows (0 = PASS); for an INFO check it is reported as
    it is.  An empty table makes every non-INFO check SKIPPED.
    """
    name: str
    observed: Column
    severity: str = FAIL
    message: str = "rows violate the check"
    recommendation: str | None = None


def sql_string(s: str | None) -> str:
    """A Spark SQL string literal (or NULL)."""
    if s is None:
        return "CAST(NULL AS STRING)"
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _error_condition(e: Exception) -> str:
    cond = getattr(e, "getCondition", None)
    try:
        name = cond() if callable(cond) else None
    except Exception:  # noqa: BLE001
        name = None
    return name or type(e).__name__


def run_checks(df: DataFrame, table_name: str, checks: list[Check], run_id: str) -> DataFrame:
    """R2: one result row per check, all computed in one aggregate pass.

    The aggregate row is unpivoted with one ``stack`` generator; the result
    rows are SQL expressions over that single row.  A check that cannot be
    evaluated on ``df`` (for example it names a column the principal cannot
    see) does not stop the run: it yields a WARNING row (FAIL for a FAIL
    check) naming the error condition.  Analysis errors are found without
    running a job.
    """
    good: list[tuple[int, Check]] = []
    failed: list[tuple[Check, str]] = []
    for c in checks:
        try:
            df.agg(c.observed.alias("x")).schema        # analysis only
            good.append((len(good), c))
        except Exception as e:  # noqa: BLE001
            failed.append((c, _error_condition(e)))
    one = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[c.observed.cast("bigint").alias(f"__c{i}") for i, c in good])
    rows = []
    for i, c in good:
        obs = f"__c{i}"
        if c.severity == INFO:
            status = sql_string(INFO)
            message = f"concat({sql_string(c.message + ': ')}, CAST({obs} AS STRING))"
        else:
            status = (f"CASE WHEN __rows = 0 THEN {sql_string(SKIPPED)} "
                      f"WHEN coalesce({obs}, 0) = 0 THEN {sql_string(PASS)} ELSE {sql_string(c.severity)} END")
            message = (f"concat(CAST({obs} AS STRING), ' of ', CAST(__rows AS STRING), "
                       f"{sql_string(' rows: ' + c.message)})")
        details = f"map('rows_checked', CAST(__rows AS STRING), 'observed', CAST({obs} AS STRING))"
        rows.append(f"{sql_string(c.name)}, {status}, {message}, {obs}, {details}, "
                    f"{sql_string(c.recommendation)}")
    for c, cond in failed:
        status = FAIL if c.severity == FAIL else WARNING
        rows.append(f"{sql_string(c.name)}, {sql_string(status)}, "
                    f"{sql_string('Could not evaluate the check: ' + cond)}, CAST(NULL AS BIGINT), "
                    f"map('error', {sql_string(cond)}), {sql_string(c.recommendation)}")
    stack = (f"stack({len(rows)}, {', '.join(rows)}) "
             f"AS (check_name, status, message, observed, details, recommendation)")
    return one.selectExpr(f"{sql_string(run_id)} AS run_id", f"{sql_string(table_name)} AS table_name", stack)


def access_checks(visible: DataFrame, catalog_columns: list[str]) -> list[Check]:
    """The three table checks of the access diagnostics, as aggregates.

    read access: rows the principal can read; column filtering: how many
    catalog columns are hidden (schema only, no data); row filtering: the
    accessible row count, to compare with an expected count.
    """
    hidden = [c for c in dict.fromkeys(catalog_columns) if c and c not in visible.columns]
    # The rows, counted so that every visible column is really read.
    every = F.greatest(F.count(F.lit(1)), F.lit(0).cast("bigint"), *[F.count(F.col(f"`{c.replace('`', '``')}`")) for c in visible.columns])
    return [
        Check("readable rows", every, INFO, "rows readable"),
        Check("hidden columns", F.lit(len(hidden)), INFO, "columns hidden"),
        Check("rows behind the row policy", F.count(F.lit(1)), INFO, "accessible rows",
              "Hold this number against what the policy should let through"),
    ]


def status_rollup(results: DataFrame) -> DataFrame:
    """A2: per run the number of checks and of PASS / FAIL / WARNING.

    SKIPPED and INFO count only in ``total_checks``.
    """
    st = F.col("status")
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(st == PASS).alias("passed"),
        F.count_if(st == FAIL).alias("failed"),
        F.count_if(st == WARNING).alias("warnings"))


def run_report(results: DataFrame, job_name: str, timestamp: str, version: str) -> DataFrame:
    """One row per run: header, A2 counts, and every result, sorted by
    table and check name."""
    st = F.col("status")
    item = F.struct("table_name", "check_name", "status", "message", "observed", "recommendation")
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(st == PASS).alias("passed"),
        F.count_if(st == FAIL).alias("failed"),
        F.count_if(st == WARNING).alias("warnings"),
        F.array_sort(F.collect_list(item)).alias("results"),
    ).select(F.lit(job_name).alias("job_name"), "run_id", F.lit(timestamp).alias("timestamp"),
             F.lit(version).alias("version"), "total_checks", "passed", "failed", "warnings",
             "results")


def _comparable(df: DataFrame) -> DataFrame:
    """Maps can be neither grouped nor hashed: compare a top-level map as the
    sorted array of its entries (equal maps give equal arrays)."""
    return df.select(*[
        F.array_sort(F.map_entries(F.col(f.name))).alias(f.name) if isinstance(f.dataType, MapType)
        else F.col(f.name) for f in df.schema.fields])


def _row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row.  A NULL adds nothing to a hash, so every
    column brings its own NULL mark; nested values are hashed as the text of
    their fingerprint, which keeps NULL fields and microseconds."""
    marked = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col(f"`{f.name.replace('`', '``')}`")
        marked += [c.isNull(), encoded(c, f.dataType) if isinstance(f.dataType, (StructType, ArrayType, MapType)) else c]
    return F.xxhash64(F.lit("a"), *marked), F.xxhash64(F.lit("b"), *reversed(marked))


def fingerprint_sums(df: DataFrame) -> list[Column]:
    """Aggregates that tell multisets of rows with the columns of ``df`` apart:
    the count and two exact sums of row hashes.  Usable in ``observe``."""
    h, g = _row_hashes(df)
    exact = lambda x: F.coalesce(F.sum(x.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("n"), exact(h).alias("h"), exact(g).alias("g")]


def verify_equal(left: DataFrame, right: DataFrame, method: str = "exact") -> DataFrame:
    """Are two DataFrames the same multiset of rows?

    ``exact``: both sides are tagged, unioned and grouped by every column
    (NULLs group together, duplicates count), one shuffle with map-side
    pre-aggregation; reports rows only on the left / only on the right.
    ``fingerprint``: no shuffle at all: row count plus the exact decimal sums
    of two 64-bit hashes of every row on each side, with a NULL mark for every
    column; equal sums mean equal multisets with high probability.  For
    very large written tables.  Columns of different types are an error.
    """
    cols = left.columns
    if sorted(cols) != sorted(right.columns):
        raise ValueError(f"different columns: {cols} vs {right.columns}")
    kinds = [(c, left.schema[c].dataType.simpleString(), right.schema[c].dataType.simpleString()) for c in cols]
    other = [k for k in kinds if k[1] != k[2]]
    if other:
        raise ValueError(f"different types: {other}")
    right = right.select(*cols)
    if method == "fingerprint":
        h, g = (x.cast("decimal(38,0)").alias(n) for x, n in zip(_row_hashes(left), "hg"))
        both = (left.select(F.lit(True).alias("__l"), h, g)
                .unionByName(right.select(F.lit(False).alias("__l"), h, g)))
        on_left, on_right = F.col("__l"), ~F.col("__l")
        sums = both.agg(
            F.count_if(on_left).alias("left_rows"), F.count_if(on_right).alias("right_rows"),
            F.sum(F.when(on_left, F.col("h"))).alias("left_sum"),
            F.sum(F.when(on_right, F.col("h"))).alias("right_sum"),
            F.sum(F.when(on_left, F.col("g"))).alias("left_sum2"),
            F.sum(F.when(on_right, F.col("g"))).alias("right_sum2"))
        return sums.select("left_rows", "right_rows",
                           ((F.col("left_rows") == F.col("right_rows"))
                            & F.col("left_sum").eqNullSafe(F.col("right_sum"))
                            & F.col("left_sum2").eqNullSafe(F.col("right_sum2"))).alias("equal"))
    if method != "exact":
        raise ValueError(f"unknown method {method!r}: use 'exact' or 'fingerprint'")
    left, right = _comparable(left), _comparable(right)
    tagged = (left.select(*cols, F.lit(1).alias("__l"), F.lit(0).alias("__r"))
              .unionByName(right.select(*cols, F.lit(0).alias("__l"), F.lit(1).alias("__r"))))
    per_row = tagged.groupBy(*cols).agg(F.sum("__l").alias("l"), F.sum("__r").alias("r"))
    summary = per_row.agg(
        F.coalesce(F.sum("l"), F.lit(0)).cast("bigint").alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).cast("bigint").alias("right_rows"),
        F.coalesce(F.sum(F.greatest(F.col("l") - F.col("r"), F.lit(0))), F.lit(0)).cast("bigint").alias("left_only"),
        F.coalesce(F.sum(F.greatest(F.col("r") - F.col("l"), F.lit(0))), F.lit(0)).cast("bigint").alias("right_only"))
    return summary.withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def table_summary(tables: list[tuple[str, DataFrame, DataFrame]], with_files: bool = False) -> DataFrame:
    """Per table the accessible rows and visible / hidden columns.

    ``tables`` holds (name, full table, governed view).  One aggregate per
    table, unioned.  With ``with_files`` the data files and bytes of each
    full table are added from the hidden ``_metadata`` column (the full
    table must be a file scan); both parts are merged per table by a
    grouping, not a join.
    """
    parts = []
    for name, full, visible in tables:
        n_hidden = len([c for c in full.columns if c not in visible.columns])
        rows = visible.agg(F.count(F.lit(1)).alias("visible_rows")).select(
            F.lit(name).alias("table_name"), "visible_rows",
            F.lit(len(visible.columns)).alias("visible_columns"),
            F.lit(n_hidden).alias("hidden_columns"))
        if with_files:
            files = (full.select(F.col("_metadata.file_path").alias("p"),
                                 F.col("_metadata.file_size").alias("s")).distinct()
                     .agg(F.count(F.lit(1)).alias("files"), F.sum("s").alias("bytes")))
            rows = (rows.select("*", F.lit(None).cast("bigint").alias("files"),
                                F.lit(None).cast("bigint").alias("bytes"))
                    .unionByName(files.select(F.lit(name).alias("table_name"),
                                              F.lit(None).cast("bigint").alias("visible_rows"),
                                              F.lit(None).cast("int").alias("visible_columns"),
                                              F.lit(None).cast("int").alias("hidden_columns"),
                                              "files", F.col("bytes").cast("bigint")))
                    .groupBy("table_name")
                    .agg(*[F.max(c).alias(c) for c in ("visible_rows", "visible_columns",
                                                        "hidden_columns", "files", "bytes")]))
        parts.append(rows)
    return reduce(DataFrame.unionByName, parts)

"""The registered queries, one per operator of the survey's inventory.

Each function takes (spark, sf_dir) and returns a lazy DataFrame over the
given tables.  Computed columns carry the same names as in the oracle SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions.columns import null_default, partition_columns, row_fingerprint, ts_literal
from lakewright.functions.columns import row_hash as row_hash_of
from lakewright.operators import checks as C
from lakewright.operators import governance as G
from lakewright.operators import merge as J
from lakewright.operators import transform as P
from lakewright.operators import versions as V
from lakewright.operators import stored_log as L
from lakewright.operators.maintenance import compact_table, compaction_plan, relocate
from lakewright.plans import fixtures as fx
from lakewright.sources import tables as S
from lakewright.sources.files import file_inventory, list_objects, partition_inventory, read_csv, read_json, read_text
from lakewright.streaming import incremental
from lakewright.etl import etl_transform, run_etl
from lakewright.sinks.writers import (
    TEXT_TIMESTAMP_OPTIONS, _delete_path, append_once, create_table, insert_into, merge_into_path, save_report, write_table,
    write_verified,
)

Query = Callable[[SparkSession, str], DataFrame]


# --- scans (S) -------------------------------------------------------------

def scan_table(spark, d):
    return fx.events_x1(spark, d)


def scan_filtered(spark, d):
    return S.read_table_with_filter(fx.events_x1(spark, d), fx.SCAN_FILTER)


def scan_incremental(spark, d):
    return S.read_incremental(fx.events_x1(spark, d), "event_timestamp", fx.INCREMENTAL_MARK)


def incremental_next_mark(spark, d):
    inc = S.read_incremental(fx.events_x1(spark, d), "event_timestamp", fx.INCREMENTAL_MARK)
    return S.next_mark(inc, "event_timestamp")


def sample_access(spark, d):
    return S.sample_access(fx.events_x1(spark, d), fx.SAMPLE_N, ["id"])


def object_listing(spark, d):
    """S10 listing: every data file under the folder of the given tables."""
    return list_objects(spark, d).select("name", "bytes")


def file_inventory_q(spark, d):
    return file_inventory(fx.table(spark, d, "events")).select("file_name", "rows", "bytes")


def inventory_rows(spark, d):
    """Data files and rows of every given table, from the file footers on
    the executors (no column is read), rolled up per table."""
    parts = [partition_inventory(fx.table(spark, d, t)).select(F.lit(t).alias("table_name"), "rows", (F.col("bytes") > 0).alias("has_bytes"))
             for t in fx.TABLES]
    return reduce(DataFrame.unionByName, parts)


def scan_text(spark, d):
    """The events' payloads written as text, read back line by line."""
    path = _scratch(spark, "text")
    fx.table(spark, d, "events").select("props").write.text(path)
    return read_text(spark, path)


# --- governed scans and audits (G) -----------------------------------------

def governed_rows_predicate(spark, d):
    return G.apply_row_policy(fx.table(spark, d, "events"), fx.EVENT_ROW_POLICY)


def governed_rows_entitled(spark, d):
    return G.entitled_rows(fx.table(spark, d, "orders"), fx.entitlements(spark, d),
                           [("o_custkey", "c_custkey")])


def governed_columns(spark, d):
    return G.governed_scan(fx.table(spark, d, "customer"), fx.customer_policy())


def _grant_resolution(spark, d):
    return G.resolve_grants(G.read_requests(fx.grant_reads(spark, d)), fx.grants(spark, d))


def grants_allowed(spark, d):
    return _grant_resolution(spark, d)[0]


def grants_denied(spark, d):
    return _grant_resolution(spark, d)[1]


def audit_columns(spark, d):
    full = fx.table(spark, d, "customer")
    return G.audit_columns(full, G.governed_scan(full, fx.customer_policy()), "customer")


def audit_rows(spark, d):
    return G.audit_rows(fx.table(spark, d, "events"), fx.AUDIT_POLICIES)


# --- projection and functions (P) ------------------------------------------

def event_transform(spark, d):
    return P.transform_events(fx.events_x1(spark, d), as_of=fx.AS_OF)


def event_partition_columns(spark, d):
    ev = fx.events_x1(spark, d)
    return ev.select("id", *[c.alias(n) for n, c in partition_columns("event_timestamp").items()])


def null_default_q(spark, d):
    # The test data has no NULL event types: 'error' is turned into NULL first.
    ev = fx.events_x1(spark, d)
    return ev.select("id", null_default(F.nullif(F.col("event_type"), F.lit("error"))).alias("event_type"))


def row_hash(spark, d):
    return event_transform(spark, d).select("id", "row_hash")


def row_fingerprint_q(spark, d):
    ev = fx.events_x1(spark, d)
    return ev.select("id", row_fingerprint([(c, ev.schema[c].dataType) for c in ev.columns]).alias("fingerprint"))


def dedup_latest(spark, d):
    li = fx.table(spark, d, "lineitem")
    return P.dedup_latest(li, ["l_orderkey", "l_linenumber"], ["l_shipdate"])


def conform_schema(spark, d):
    # Columns out of order, a timestamp to cast, and missing nullable
    # columns (processed_at, year, month, day) to fill with typed NULLs.
    ev = fx.events_x1(spark, d)
    ev = ev.select(row_hash_of("id", "event_timestamp").alias("row_hash"),
                   "event_timestamp", "event_data", "user_id", "event_type", "id")
    return P.conform_schema(ev, P.EVENT_TABLE_SCHEMA)


# --- merge (J) -------------------------------------------------------------

def upsert_all(spark, d):
    return J.upsert(fx.orders_target(spark, d), fx.orders_batch(spark, d), "o_orderkey")


def upsert_subset(spark, d):
    return J.upsert(fx.orders_target(spark, d), fx.orders_batch(spark, d), "o_orderkey",
                    update_columns=["o_totalprice"])


def upsert_with_deletes(spark, d):
    batch = fx.orders_batch(spark, d)
    batch = batch.withColumn("op", F.when(F.col("o_orderstatus") == "F", F.lit("D")).otherwise(F.lit("U")))
    return J.upsert(fx.orders_target(spark, d), batch, "o_orderkey", op_column="op")


def upsert_composite(spark, d):
    li = fx.table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    ship = F.col("l_shipdate")
    target = P.dedup_latest(li.where(ship < F.lit(str(fx.LINE_TARGET_BEFORE)).cast("timestamp_ntz")), keys, ["l_shipdate"])
    source = P.dedup_latest(li.where(ship >= F.lit(str(fx.LINE_SOURCE_FROM)).cast("timestamp_ntz")), keys, ["l_shipdate"])
    return J.upsert(target, source, keys, materialize=True)


def duplicate_keys(spark, d):
    return J.duplicate_keys(fx.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- versions (V) and retention (M2) ---------------------------------------

def as_of_version(spark, d):
    return V.state_as_of(fx.event_log(spark, d), fx.EVENT_LOG, version=fx.AS_OF_VERSION)


def as_of_timestamp(spark, d):
    return V.state_as_of(fx.event_log(spark, d), fx.EVENT_LOG, timestamp=fx.AS_OF_TIME)


def commit_list(spark, d):
    return V.commit_list(fx.event_log(spark, d), fx.EVENT_LOG)


def commit_history(spark, d):
    return V.commit_history(fx.event_log(spark, d), fx.EVENT_LOG)


def state_diff(spark, d):
    return V.state_diff(fx.event_log(spark, d), fx.EVENT_LOG, fx.DIFF_FROM, fx.DIFF_TO)


def expire_log(spark, d):
    return V.expire_log(fx.event_log(spark, d), fx.EVENT_LOG, fx.AS_OF, fx.RETAIN_DAYS)


# --- counts, checks, reports (A, R) ----------------------------------------

def row_count(spark, d):
    return C.row_count(fx.events_x1(spark, d))


def top_n(spark, d):
    ev = fx.events_x1(spark, d)
    return C.top_n(ev, fx.TOP_N, [F.col("event_timestamp").desc(), F.col("id").desc()])


def verify_equal(spark, d):
    """Retention must not change the state as of a time after the cutoff."""
    log = fx.event_log(spark, d)
    before = V.state_as_of(log, fx.EVENT_LOG, timestamp=fx.RETAIN_CHECK_AT)
    after = V.state_as_of(V.expire_log(log, fx.EVENT_LOG, fx.AS_OF, fx.RETAIN_DAYS),
                          fx.EVENT_LOG, timestamp=fx.RETAIN_CHECK_AT)
    return C.verify_equal(before, after)


def verify_fingerprint(spark, d):
    """R1 without a shuffle: the same retention invariant by row fingerprints."""
    log = fx.event_log(spark, d)
    before = V.state_as_of(log, fx.EVENT_LOG, timestamp=fx.RETAIN_CHECK_AT)
    after = V.state_as_of(V.expire_log(log, fx.EVENT_LOG, fx.AS_OF, fx.RETAIN_DAYS),
                          fx.EVENT_LOG, timestamp=fx.RETAIN_CHECK_AT)
    return C.verify_equal(before, after, method="fingerprint")


def _governed_tables(spark, d):
    ev = fx.table(spark, d, "events")
    orders = fx.table(spark, d, "orders")
    cust = fx.table(spark, d, "customer")
    return [
        ("events", ev, G.apply_row_policy(ev, fx.EVENT_ROW_POLICY)),
        ("orders", orders, G.entitled_rows(orders, fx.entitlements(spark, d), [("o_custkey", "c_custkey")])),
        ("customer", cust, G.governed_scan(cust, fx.customer_policy())),
    ]


def _data_checks(name: str) -> list[C.Check]:
    col = F.col
    if name == "events":
        return [C.Check("event_id not null", F.count_if(col("event_id").isNull())),
                C.Check("ts not null", F.count_if(col("ts").isNull())),
                C.Check("known event_type", F.count_if(~col("event_type").isin(
                    *fx.KNOWN_EVENT_TYPES) | col("event_type").isNull()), C.WARNING,
                    "rows with an unknown event type", "Map new event types before loading"),
                C.Check("value not negative", F.count_if(col("value") < 0), C.WARNING)]
    if name == "orders":
        return [C.Check("total price positive", F.count_if(col("o_totalprice") <= 0)),
                C.Check("known order status", F.count_if(~col("o_orderstatus").isin(*fx.KNOWN_ORDER_STATUSES)), C.WARNING)]
    return [C.Check("market segment present", F.count_if(col("c_mktsegment").isNull())),
            C.Check("nation key present", F.count_if(col("c_nationkey").isNull()), C.WARNING)]


def check_results_df(spark, d) -> DataFrame:
    parts = []
    for name, full, visible in _governed_tables(spark, d):
        checks = C.access_checks(visible, full.columns) + _data_checks(name)
        parts.append(C.run_checks(visible, name, checks, fx.RUN_ID))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_results(spark, d):
    return check_results_df(spark, d).drop("details")


def check_results_full(spark, d):
    """R2 with every column; the details, a map, as JSON."""
    return check_results_df(spark, d).withColumn("details", F.to_json("details"))


def run_report_results(spark, d):
    """R3 + K8: the report saved as JSON, read back, one row per result."""
    rep = C.run_report(check_results_df(spark, d), fx.JOB_NAME, fx.REPORT_TIME, fx.VERSION)
    path = save_report(rep, _scratch(spark, "report"), now=fx.AS_OF)
    head = ["job_name", "run_id", "timestamp", "version", "total_checks", "passed", "failed", "warnings"]
    return read_json(spark, path, rep.schema).select(*head, F.inline("results"))


def status_rollup(spark, d):
    return C.status_rollup(check_results_df(spark, d))


def run_report(spark, d):
    rep = C.run_report(check_results_df(spark, d), fx.JOB_NAME, fx.REPORT_TIME, fx.VERSION)
    first = F.col("results")[0]
    return rep.select("job_name", "run_id", "timestamp", "version", "total_checks", "passed",
                      "failed", "warnings", F.size("results").alias("n_results"),
                      first["table_name"].alias("first_table"), first["check_name"].alias("first_check"))


def table_summary(spark, d):
    return C.table_summary(_governed_tables(spark, d))


# --- sinks (K1, K2, K5-K7): verified writes of the whole event table -------

def _scratch(spark, kind: str) -> str:
    from lakewright.session import require_checkpoint_dir
    return f"{require_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _round_trip(fmt: str):
    def q(spark, d):
        return write_verified(fx.events_x1(spark, d), _scratch(spark, f"sink-{fmt}"), fmt).select(
            "left_rows", "right_rows", "equal")
    q.__name__ = f"sink_{fmt}_round_trip"
    return q


def sink_partitioned_table(spark, d):
    """K1 + K2: append the transformed events partitioned by year/month/day,
    overwrite the partitions present again (must not change the table), and
    verify the table against the data written."""
    out = etl_transform(fx.events_x1(spark, d), as_of=fx.AS_OF)
    path = _scratch(spark, "sink-table")
    parts = ["year", "month", "day"]
    write_table(out, path, "append", parts)
    write_table(out, path, "overwrite", parts)
    back = spark.read.schema(out.schema).parquet(path).select(*out.columns)
    return C.verify_equal(out, back).select("left_rows", "right_rows", "equal")


def _rows_back(fmt: str):
    def q(spark, d):
        """K5-K7: the rows of a verified write, read back from its files."""
        ev, path = fx.events_x1(spark, d), _scratch(spark, f"rows-{fmt}")
        check = write_verified(ev, path, fmt, method="observed").first()
        if not check["equal"]:
            raise RuntimeError(f"{fmt} lost rows: {check.asDict()}")
        if fmt == "json":
            return read_json(spark, path, ev.schema, **TEXT_TIMESTAMP_OPTIONS)
        if fmt == "csv":
            return read_csv(spark, path, ev.schema, **TEXT_TIMESTAMP_OPTIONS)
        return spark.read.schema(ev.schema).parquet(path)
    q.__name__ = f"sink_{fmt}_rows"
    return q


_PARTS = ["year", "month", "day"]


def _transformed(spark, d, as_of=fx.AS_OF):
    return etl_transform(fx.events_x1(spark, d), as_of=as_of)


def _stored(spark, path, schema):
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def sink_append(spark, d):
    """K1: two halves appended, the second by a run that is started again."""
    out, path = _transformed(spark, d), _scratch(spark, "append")
    late = F.col("event_timestamp") >= ts_literal(fx.INCREMENTAL_MARK)
    write_table(out.where(~late | late.isNull()), path, "append", _PARTS)
    for _ in range(2):
        append_once(out.where(late), path, "second", _PARTS)
    return _stored(spark, path, out.schema)


def sink_overwrite_partitions(spark, d):
    """K2: purchases of the later days replace all rows of those days."""
    out, path = _transformed(spark, d), _scratch(spark, "overwrite")
    write_table(out, path, "append", _PARTS)
    write_table(out.where((F.col("event_timestamp") >= ts_literal(fx.AS_OF_TIME)) & (F.col("event_type") == "purchase")),
                path, "overwrite", _PARTS)
    return _stored(spark, path, out.schema)


def catalog_table(spark, d):
    """K4 + K9: a partitioned table made in the session catalog, rows inserted
    by name and read by the table's name."""
    out, name = _transformed(spark, d), f"lakewright_{uuid.uuid4().hex}"
    create_table(spark, name, out.schema, _scratch(spark, "catalog"), _PARTS, comment="events")
    for part in (F.col("id") % 2 == 0, F.col("id") % 2 == 1):
        insert_into(out.where(part), name)
    return spark.table(name).select(*out.columns)


def relocated_table(spark, d):
    """M3: a partitioned table of orders pointed at a copy of its files."""
    orders = fx.table(spark, d, "orders").withColumn("year", F.year("o_orderdate").cast("string"))
    name, old, new = f"lakewright_{uuid.uuid4().hex}", _scratch(spark, "orders"), _scratch(spark, "orders-moved")
    create_table(spark, name, orders.schema, old, ["year"])
    insert_into(orders, name)
    write_table(spark.table(name), new, "append", ["year"])
    relocate(spark, name, new if "://" in new else "file://" + new.removeprefix("file:"))
    _delete_path(spark, old)
    return spark.table(name).select(*orders.columns)


def compacted_table(spark, d):
    """M1: events in many small files of some days and one file of the others,
    compacted by the plan, the table read back."""
    out, path = _transformed(spark, d), _scratch(spark, "compact")
    early = F.col("event_timestamp") < ts_literal(fx.AS_OF_TIME)
    for part in range(3):
        write_table(out.where(early).where(F.pmod("id", F.lit(3)) == part), path, "append", _PARTS)
    write_table(out.where(~early), path, "append", _PARTS)
    compact_table(spark, path, _PARTS, fx.COMPACTION_TARGET_BYTES)
    return _stored(spark, path, out.schema)


def _stored_log(spark, d):
    root = _scratch(spark, "log")
    log = fx.event_log(spark, d)
    L.write_commits(log.where(F.col("commit_id") <= fx.AS_OF_VERSION), root, fx.EVENT_LOG)
    L.write_baseline(spark, root, fx.EVENT_LOG, fx.BASELINE_VERSION)
    L.write_commits(log.where(F.col("commit_id") > fx.AS_OF_VERSION), root, fx.EVENT_LOG)
    return root, log.columns


def as_of_version_stored(spark, d):
    """V1 on a stored log: a baseline and the commits after it."""
    root, cols = _stored_log(spark, d)
    return L.read_as_of(spark, root, fx.EVENT_LOG, version=fx.AS_OF_VERSION).select(*cols)


def as_of_timestamp_stored(spark, d):
    root, cols = _stored_log(spark, d)
    return L.read_as_of(spark, root, fx.EVENT_LOG, timestamp=fx.AS_OF_TIME).select(*cols)


def expire_log_stored(spark, d):
    """M2 on a stored log: the rows left after retention."""
    root, cols = _stored_log(spark, d)
    L.expire_stored(spark, root, fx.EVENT_LOG, fx.AS_OF, fx.RETAIN_DAYS)
    return L.read_log(spark, root, fx.EVENT_LOG).select(*cols)


def incremental_load_table(spark, d):
    """Events arrive as files in two lots; each run of the stream loads
    what is new into a table that keeps each user's latest event."""
    ev, source, target = fx.table(spark, d, "events"), _scratch(spark, "arrivals"), _scratch(spark, "loaded")
    late = F.col("ts") >= ts_literal(fx.INCREMENTAL_MARK)
    for lot in (~late, late):
        ev.where(lot).write.mode("append").parquet(source)
        incremental.incremental_load(spark, source, ev.schema, target, merge_keys=["user_id"],
                                     partition_columns=["event_type"], order_by=["ts", "event_id"])
    return _stored(spark, target, ev.schema)


def etl_stored(spark, d):
    """L1 with its write: create, append (started twice, as after a failure),
    merge of a later batch, and the stored table read by name."""
    name, home = f"lakewright_{uuid.uuid4().hex}", _scratch(spark, "etl")
    policy = G.Policy("etl", row_filter="CAST(user_id AS BIGINT) < 50")
    ev = fx.events_x1(spark, d)
    first = ev.where(F.col("event_timestamp") < ts_literal(fx.AS_OF_TIME))
    second = ev.where(F.col("event_timestamp") >= ts_literal(fx.INCREMENTAL_MARK))
    for _ in range(2):
        run_etl(spark, first, name, home, policy=policy, as_of=fx.AS_OF_TIME, run_id="first")
    run_etl(spark, second, name, home, policy=policy, as_of=fx.AS_OF, mode="merge")
    return spark.table(name)


def merge_into_table(spark, d):
    """J1 on a stored table: the orders target written partitioned by year,
    the batch merged in by rewriting only the touched partitions, and the
    table read back."""
    year = F.year("o_orderdate").cast("string").alias("year")
    target = fx.orders_target(spark, d).select("*", year)
    batch = fx.orders_batch(spark, d).select("*", year)
    path = _scratch(spark, "merge-table")
    write_table(target, path, "overwrite", ["year"])
    merge_into_path(batch, path, ["o_orderkey"], ["year"])
    return spark.read.schema(target.schema).parquet(path).select(*target.columns)


# --- maintenance and the ETL job (M1, L1) ----------------------------------

def compaction_plan_q(spark, d):
    inv = file_inventory(fx.table(spark, d, "events"))
    return compaction_plan(inv, [], fx.COMPACTION_TARGET_BYTES)


def etl_job(spark, d):
    """L1 without the write: governed read -> transform -> table schema."""
    ev = fx.events_x1(spark, d)
    governed = G.apply_row_policy(ev, "CAST(user_id AS BIGINT) < 50")
    return etl_transform(governed, as_of=fx.AS_OF)


QUERIES: dict[str, Query] = {
    "scan_table": scan_table,
    "scan_filtered": scan_filtered,
    "scan_incremental": scan_incremental,
    "incremental_next_mark": incremental_next_mark,
    "sample_access": sample_access,
    "file_inventory": file_inventory_q,
    "object_listing": object_listing,
    "governed_rows_predicate": governed_rows_predicate,
    "governed_rows_entitled": governed_rows_entitled,
    "governed_columns": governed_columns,
    "grants_allowed": grants_allowed,
    "grants_denied": grants_denied,
    "audit_columns": audit_columns,
    "audit_rows": audit_rows,
    "event_transform": event_transform,
    "event_partition_columns": event_partition_columns,
    "null_default": null_default_q,
    "row_hash": row_hash,
    "row_fingerprint": row_fingerprint_q,
    "dedup_latest": dedup_latest,
    "conform_schema": conform_schema,
    "upsert_all": upsert_all,
    "upsert_subset": upsert_subset,
    "upsert_with_deletes": upsert_with_deletes,
    "upsert_composite": upsert_composite,
    "duplicate_keys": duplicate_keys,
    "as_of_version": as_of_version,
    "as_of_timestamp": as_of_timestamp,
    "commit_list": commit_list,
    "commit_history": commit_history,
    "state_diff": state_diff,
    "expire_log": expire_log,
    "row_count": row_count,
    "top_n": top_n,
    "verify_equal": verify_equal,
    "verify_fingerprint": verify_fingerprint,
    "check_results": check_results,
    "status_rollup": status_rollup,
    "run_report": run_report,
    "table_summary": table_summary,
    "sink_json_round_trip": _round_trip("json"),
    "sink_parquet_round_trip": _round_trip("parquet"),
    "sink_csv_round_trip": _round_trip("csv"),
    "sink_partitioned_table": sink_partitioned_table,
    "merge_into_table": merge_into_table,
    "compaction_plan": compaction_plan_q,
    "etl_job": etl_job,
    "inventory_rows": inventory_rows,
    "scan_text": scan_text,
    "check_results_full": check_results_full,
    "run_report_results": run_report_results,
    "sink_json_rows": _rows_back("json"),
    "sink_parquet_rows": _rows_back("parquet"),
    "sink_csv_rows": _rows_back("csv"),
    "sink_append": sink_append,
    "sink_overwrite_partitions": sink_overwrite_partitions,
    "catalog_table": catalog_table,
    "relocated_table": relocated_table,
    "compacted_table": compacted_table,
    "as_of_version_stored": as_of_version_stored,
    "as_of_timestamp_stored": as_of_timestamp_stored,
    "expire_log_stored": expire_log_stored,
    "incremental_load_table": incremental_load_table,
    "etl_stored": etl_stored,
}

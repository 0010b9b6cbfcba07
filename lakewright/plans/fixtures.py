"""Stand-in tables derived from the driver's test tables.

The event table, the change log, the upsert target/batch and the policies
are all *derived* from the given parquet tables by Spark, so every query's
work grows with the data.  Parameters below are fixed values shared with
the SQL oracle.
"""

from __future__ import annotations

import datetime as _dt
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators.governance import Policy
from lakewright.operators.versions import ChangeLog

# Fixed parameters of the registered queries (the oracle uses the same).
AS_OF = _dt.datetime(2024, 1, 31, 0, 0, 0)              # processing time / "now"
INCREMENTAL_MARK = _dt.datetime(2024, 1, 15, 12, 0, 0, 500000)
SCAN_FILTER = "event_type = 'purchase'"
EVENT_ROW_POLICY = "user_id < 50"
ENTITLED_NATION = 7
HIDDEN_CUSTOMER_COLUMNS = ("c_acctbal",)
AUDIT_POLICIES = {                                       # principal -> row filter
    "analyst_low_users": "user_id < 50",
    "analyst_purchases": "event_type = 'purchase'",
    "admin": "",
}
TARGET_BEFORE = _dt.datetime(2000, 1, 1)                 # upsert target: orders before
SOURCE_FROM = _dt.datetime(1999, 6, 1)                   # upsert batch: orders from
LINE_TARGET_BEFORE = _dt.datetime(1997, 1, 1)
LINE_SOURCE_FROM = _dt.datetime(1996, 1, 1)
AS_OF_VERSION = 15
BASELINE_VERSION = 10
AS_OF_TIME = _dt.datetime(2024, 1, 20, 12, 0, 0)
DIFF_FROM = _dt.datetime(2024, 1, 10, 0, 0, 0)
DIFF_TO = _dt.datetime(2024, 1, 20, 0, 0, 0)
RETAIN_DAYS = 7
RETAIN_CHECK_AT = _dt.datetime(2024, 1, 28, 0, 0, 0)
TOP_N = 10
SAMPLE_N = 10
GRANT_DATABASE = "sales"
GRANT_TABLE = "orders"
GRANT_SEGMENTS = ("BUILDING", "AUTOMOBILE")
RUN_ID = "run-0001"
JOB_NAME = "lakewright-checks"
REPORT_TIME = "2024-01-31T00:00:00"
VERSION = "1"
COMPACTION_TARGET_BYTES = 134_217_728
KNOWN_EVENT_TYPES = ("click", "view", "purchase", "signup", "error")
KNOWN_ORDER_STATUSES = ("F", "O", "P")

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")

EVENT_LOG = ChangeLog(keys=("user_id",), commit_id="commit_id", committed_at="ts", tie="event_id")


_HANDLES: "weakref.WeakKeyDictionary[SparkSession, dict[str, DataFrame]]" = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A read handle of a given table, opened once per session.

    Opening a parquet path lists files and reads a footer on the driver
    (~0.1 s each); the handle -- a plan, not data -- is reused, as a
    catalog table's file listing would be.  Entries die with the session.
    """
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    try:
        handles = _HANDLES.setdefault(spark, {})
    except TypeError:                      # session object not weak-referenceable
        return spark.read.parquet(path)
    if path not in handles:
        handles[path] = spark.read.parquet(path)
    return handles[path]


def events_x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the event table: id, event_type, user_id (string),
    event_data, event_timestamp.  The timestamp stays TIMESTAMP_NTZ so that
    comparisons with it reach the parquet scan; the table schema casts it."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "event_type",
        F.col("user_id").cast("string").alias("user_id"),
        F.col("props").alias("event_data"),
        F.col("ts").alias("event_timestamp"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a change log: key user_id, one commit per calendar day."""
    ev = table(spark, sf_dir, "events")
    return ev.withColumn("commit_id", F.dayofmonth("ts").cast("bigint"))


def customer_policy() -> Policy:
    return Policy("analyst_customers", hidden_columns=HIDDEN_CUSTOMER_COLUMNS)


def entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one nation: the principal's entitlement list."""
    return (table(spark, sf_dir, "customer")
            .where(F.col("c_nationkey") == ENTITLED_NATION).select("c_custkey"))


def orders_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where(F.col("o_orderdate") < F.lit(TARGET_BEFORE.isoformat(sep=" ")).cast("timestamp_ntz"))


def orders_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change batch: orders from a date, with new prices and priorities so
    that updates are visible; status 'F' marks a delete."""
    o = table(spark, sf_dir, "orders")
    b = o.where(F.col("o_orderdate") >= F.lit(SOURCE_FROM.isoformat(sep=" ")).cast("timestamp_ntz"))
    return b.withColumns({
        "o_totalprice": F.col("o_totalprice") + F.lit(1.0),
        "o_orderpriority": F.concat(F.lit("U-"), F.col("o_orderpriority")),
    })


def grant_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a read of the orders table by its customer."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("principal"),
        F.lit(GRANT_DATABASE).alias("database_name"),
        F.lit(GRANT_TABLE).alias("table_name"))


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants per customer: DESCRIBE on the database for customers with a
    non-negative balance; SELECT and DESCRIBE on the table for two
    market segments.  One scan of ``customer``: each row emits its grants
    with ``explode`` of the applicable (table, permission) pairs."""
    c = table(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment").isin(*GRANT_SEGMENTS)
    pair = lambda t, p: F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"))
    options = F.array(
        F.when(F.col("c_acctbal") >= 0, pair("*", "DESCRIBE")),
        F.when(seg, pair(GRANT_TABLE, "SELECT")),
        F.when(seg, pair(GRANT_TABLE, "DESCRIBE")))
    return (c.select(F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("principal"),
                     F.explode(F.filter(options, lambda g: g.isNotNull())).alias("g"))
            .select("principal", F.lit(GRANT_DATABASE).alias("database_name"),
                    F.col("g.t").alias("table_name"), F.col("g.p").alias("permission")))

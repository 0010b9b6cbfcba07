"""Session helper.

The library never overrides settings a cluster already carries; it only
fills in defaults that matter for correct results (UTC session time zone,
string partition values) and for runtime re-planning (AQE).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings applied only when the session does not carry them already.
_DEFAULTS = {
    # Naive timestamps in literals and "now" must mean the same instant.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesce small shuffles, split skewed join
    # partitions, turn joins into broadcast joins from real sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Partition columns year/month/day are strings; path discovery must not
    # turn them into integers.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}
# Writers pass dynamic partition overwrite and zstd as write options, so the
# session's own settings for other writes stay as they are.


def get_session(master: str | None = None, app_name: str = "lakewright",
                extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session, or build one (tests, bench, local runs)."""
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        apply_defaults(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in {**_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_defaults(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Set library defaults that are still unset on ``spark``."""
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    # The session zone always has a value (the JVM zone).  Partition values,
    # time-travel marks and retention cutoffs are defined in UTC, so this one
    # setting is pinned rather than defaulted.
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str | None:
    """Shared folder for lineage cuts and staged writes.

    On a cluster this is ``spark.checkpoint.dir`` (a shared file system the
    cluster names).  Only when it is unset -- tests and local runs -- a
    fresh local folder is created and recorded in the session.  Returns
    None when the session exposes no SparkContext and names no folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (a session without a local context)
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            return None                    # a folder of this machine is no shared folder
        d = tempfile.mkdtemp(prefix="lakewright-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def require_checkpoint_dir(spark: SparkSession) -> str:
    """``checkpoint_dir`` or a clear error when no shared folder is known."""
    d = checkpoint_dir(spark)
    if not d:
        raise ValueError("no shared folder: set spark.checkpoint.dir or pass a path explicitly")
    return d

"""A change log on storage: deltas by commit, baselines, retention
(V1, V2, M2 without reading the whole log).

``<root>/deltas/commit_id=n``        the rows of a commit
``<root>/commits/commit_id=n``       one row: rows, first and last time, rows without a time
``<root>/baselines/baseline=name``   a state: the latest row per key, deletes left out
``<root>/marks/baseline=name``       one row: what the baseline covers

A delta or baseline counts once its one-row record is there, which is
written last, so a lost writer leaves nothing that is read; writing a commit
or baseline again replaces it.  A snapshot holds the state as of commit n, and
deltas up to n are not read with it.  A retained baseline is what
retention leaves of expired commits; all deltas still there are read with it.
One writer at a time may work on a log; readers need not wait: a state read
between two steps is the state.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakewright.functions.columns import ts_literal
from lakewright.operators.versions import DEFAULT_RETAIN_DAYS, ChangeLog, retention_cutoff, state_as_of
from lakewright.sinks.writers import _delete_path, pending_path, read_if_there, write_table

SNAPSHOT, RETAINED = "snapshot", "retained"


def _commits(spark: SparkSession, root: str) -> list:
    """The records of the commits: metadata, on the driver."""
    df = read_if_there(spark, f"{root}/commits")
    return [] if df is None else df.withColumn("commit_id", F.col("commit_id").cast("bigint")).orderBy("commit_id").collect()


def _marks(spark: SparkSession, root: str) -> list:
    df = read_if_there(spark, f"{root}/marks")
    return [] if df is None else df.orderBy("number").collect()


def _span(log: ChangeLog) -> list:
    at = F.col(log.committed_at)
    return [F.count(F.lit(1)).alias("rows"), F.min(at).alias("first_at"), F.max(at).alias("last_at"),
            F.count_if(at.isNull()).alias("untimed")]


def write_commits(df: DataFrame, root: str, log: ChangeLog) -> None:
    """Add the commits of ``df`` to the log, or replace them.  Rows without a
    commit id are refused."""
    c = log.commit_id
    if df.where(F.col(c).isNull()).take(1):
        raise ValueError(f"rows without {c}")
    write_table(df.withColumnRenamed(c, "commit_id"), f"{root}/deltas", "overwrite", ["commit_id"])
    write_table(df.groupBy(F.col(c).alias("commit_id")).agg(*_span(log)), f"{root}/commits", "overwrite", ["commit_id"], rebalance=False)


def _read(spark: SparkSession, root: str, baseline, commits: list, log: ChangeLog) -> DataFrame:
    """A baseline and the deltas of ``commits``, by their folders: no other
    folder of the log is listed."""
    def back(df: DataFrame) -> DataFrame:
        return df.withColumn("commit_id", F.col("commit_id").cast("bigint")).withColumnRenamed("commit_id", log.commit_id)
    parts = []
    if baseline is not None and baseline["rows"]:
        parts.append(back(spark.read.parquet(f"{root}/baselines/baseline={baseline['baseline']}")))
    if commits or not parts:
        at = [f"{root}/deltas/commit_id={r['commit_id']}" for r in commits] or [f"{root}/deltas"]
        deltas = back(spark.read.option("basePath", f"{root}/deltas").parquet(*at))
        parts.append(deltas if commits else deltas.limit(0))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_as_of(spark: SparkSession, root: str, log: ChangeLog, version: int | None = None,
               timestamp: _dt.datetime | None = None) -> DataFrame:
    """V1/V2 on a stored log: the state as of a commit or a time (both
    inclusive), from the latest baseline that serves and later commits only.

    For a time, a snapshot serves if all its rows have a time, at most this
    one.  After retention, states before its cutoff are gone.
    """
    if (version is None) == (timestamp is None):
        raise ValueError("give a version or a timestamp, not both or none")
    commits, marks = _commits(spark, root), _marks(spark, root)
    if timestamp is not None:
        t = timestamp.astimezone(_dt.timezone.utc).replace(tzinfo=None) if timestamp.tzinfo else timestamp
    serves = lambda r: (r["number"] <= version if version is not None
                        else not r["untimed"] and (r["last_at"] is None or r["last_at"] <= t))
    snapshots = [r for r in marks if r["kind"] == SNAPSHOT and serves(r)]
    retained = [r for r in marks if r["kind"] == RETAINED]
    base = snapshots[-1] if snapshots else retained[-1] if retained else None
    after = base["number"] if snapshots else None
    needed = [r for r in commits if (after is None or r["commit_id"] > after)
              and (r["commit_id"] <= version if version is not None else r["first_at"] is not None and r["first_at"] <= t)]
    return state_as_of(_read(spark, root, base, needed, log), log, version=version, timestamp=timestamp)


def read_log(spark: SparkSession, root: str, log: ChangeLog) -> DataFrame:
    """All rows of the log: those of the retained baseline and of every delta."""
    retained = [r for r in _marks(spark, root) if r["kind"] == RETAINED]
    return _read(spark, root, retained[-1] if retained else None, _commits(spark, root), log)


def _drop_baseline(spark: SparkSession, root: str, name: str) -> None:
    _delete_path(spark, f"{root}/marks/baseline={name}")
    _delete_path(spark, f"{root}/baselines/baseline={name}")


def _put_baseline(spark: SparkSession, root: str, state: DataFrame, number: int, kind: str, last_at, untimed: int, log: ChangeLog) -> None:
    name = f"{kind}-{number}"
    rows = state.withColumnRenamed(log.commit_id, "commit_id").withColumn("baseline", F.lit(name))
    write_table(rows, f"{root}/baselines", "overwrite", ["baseline"])
    held = read_if_there(spark, f"{root}/baselines/baseline={name}")
    n = 0 if held is None else held.count()
    mark = spark.createDataFrame([(name, number, kind, n, last_at, untimed)],
                                 "baseline string, number long, kind string, rows long, last_at timestamp_ntz, untimed long")
    write_table(mark, f"{root}/marks", "overwrite", ["baseline"], rebalance=False)


def write_baseline(spark: SparkSession, root: str, log: ChangeLog, version: int) -> None:
    """A snapshot of the state as of ``version``: later reads begin there."""
    earlier = [r for r in _marks(spark, root) if r["kind"] == RETAINED]
    covered = [r for r in _commits(spark, root) if r["commit_id"] <= version] + earlier
    last = max((r["last_at"] for r in covered if r["last_at"] is not None), default=None)
    _drop_baseline(spark, root, f"{SNAPSHOT}-{version}")        # also what a lost writer left; reads do without it
    state = read_as_of(spark, root, log, version=version)
    _put_baseline(spark, root, state, version, SNAPSHOT, last, sum(r["untimed"] for r in covered), log)


def expire_stored(spark: SparkSession, root: str, log: ChangeLog, as_of: _dt.datetime,
                  retain_days: int = DEFAULT_RETAIN_DAYS) -> bool:
    """M2 on a stored log: the same rows stay as from ``expire_log``.

    Commits wholly at or before the cutoff go with their folders; those that
    reach over it are rewritten without their expired rows; the latest of the
    expired rows of each key become the retained baseline.  Commits after the
    cutoff are not read.  The new rows are staged and sealed beside the log; the next
    call finishes what a lost driver left.  Returns whether anything expired.
    """
    root = root.rstrip("/")
    _finish_expiry(spark, root, log)
    cutoff = retention_cutoff(as_of, retain_days)
    commits = _commits(spark, root)
    begun = [r for r in commits if r["first_at"] is not None and r["first_at"] <= cutoff]
    if not begun:
        return False
    gone = [r["commit_id"] for r in begun if r["last_at"] <= cutoff and not r["untimed"]]
    border = [r for r in begun if r["commit_id"] not in set(gone)]
    staging = pending_path(root)
    state = read_as_of(spark, root, log, timestamp=cutoff)
    state.withColumnRenamed(log.commit_id, "commit_id").write.parquet(f"{staging}/state")
    if border:
        at = F.col(log.committed_at)
        left = _read(spark, root, None, border, log).where((at > ts_literal(cutoff)) | at.isNull())
        left.withColumnRenamed(log.commit_id, "commit_id").write.parquet(f"{staging}/border")
    marks = _marks(spark, root)
    # A snapshot before a commit that lost rows would need those rows.
    newest = max(r["commit_id"] for r in begun)
    stale = [r["baseline"] for r in marks if r["kind"] == RETAINED or r["number"] < newest]
    number = 1 + max([r["number"] for r in marks if r["kind"] == RETAINED], default=-1)
    last = max([r["last_at"] for r in begun if r["last_at"] <= cutoff], default=cutoff)
    order = spark.createDataFrame([(number, last, gone, stale, [r["commit_id"] for r in border], state.schema.json())],
                                  "number long, last_at timestamp_ntz, gone array<long>, stale array<string>, border array<long>, kinds string")
    order.coalesce(1).write.parquet(f"{staging}/ready")
    _finish_expiry(spark, root, log)
    return True


def _finish_expiry(spark: SparkSession, root: str, log: ChangeLog) -> None:
    """Carry out a sealed retention; every step can be run again."""
    import json
    staging = pending_path(root)
    ready = read_if_there(spark, f"{staging}/ready")
    if ready is None:
        _delete_path(spark, staging)
        return
    todo = ready.first()
    kinds = StructType.fromJson(json.loads(todo["kinds"]))
    staged = lambda name: spark.read.schema(StructType(
        [f if f.name != log.commit_id else type(f)("commit_id", f.dataType) for f in kinds.fields])).parquet(f"{staging}/{name}").withColumnRenamed("commit_id", log.commit_id)
    if todo["number"] not in [r["number"] for r in _marks(spark, root) if r["kind"] == RETAINED]:
        _put_baseline(spark, root, staged("state"), todo["number"], RETAINED, todo["last_at"], 0, log)
    for name in todo["stale"]:                  # before the commits they would be read with lose rows
        _drop_baseline(spark, root, name)
    # From the oldest commit on: while expired rows of a key are left, the
    # latest of them is, so no deleted key comes back on the way.
    for n in sorted([*todo["gone"], *todo["border"]]):
        if n in todo["border"]:
            write_commits(staged("border").where(F.col(log.commit_id) == n), root, log)
        else:
            _delete_path(spark, f"{root}/commits/commit_id={n}")
            _delete_path(spark, f"{root}/deltas/commit_id={n}")
    _delete_path(spark, f"{staging}/ready")
    _delete_path(spark, staging)

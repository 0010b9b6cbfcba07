"""Skew experiment: one key holds a third of all rows.

Usage: python tools/skew_check.py <scratch_dir> [copies]

Builds (in <scratch_dir>) a multi-file copy of lineitem, ``copies`` times
the sf0.1 table, where a third of the rows share one (l_orderkey,
l_linenumber) key, plus the same data without the hot key.  Runs dedup,
duplicate-key counting and an upsert whose batch is too large to
broadcast (shuffle path), and prints per stage the task count and the
longest / median task time from Spark's event log in <scratch_dir>.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from lakewright.operators.merge import duplicate_keys, upsert  # noqa: E402
from lakewright.operators.transform import dedup_latest  # noqa: E402
from lakewright.session import get_session  # noqa: E402

KEYS = ["l_orderkey", "l_linenumber"]


def stages(log_dir: str) -> dict[int, list[float]]:
    out: dict[int, list[float]] = {}
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path) or not os.path.basename(path).startswith("events_"):
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                if ev.get("Event") == "SparkListenerTaskEnd":
                    info = ev["Task Info"]
                    out.setdefault(ev["Stage ID"], []).append(
                        (info["Finish Time"] - info["Launch Time"]) / 1000.0)
    return out


def main():
    scratch = sys.argv[1]
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    logs = os.path.join(scratch, "events")
    os.makedirs(logs, exist_ok=True)
    spark = get_session("local[8]", extra={
        "spark.sql.shuffle.partitions": "32",
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": logs,
        "spark.eventLog.compress": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8MB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8MB",
    })
    li = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    base = (li.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
            .withColumn("l_orderkey", F.col("l_orderkey") + F.col("_c") * 10_000_000).drop("_c"))
    hot = base.withColumn("l_orderkey", F.when(F.rand(7) < 1 / 3, F.lit(1)).otherwise(F.col("l_orderkey")))
    hot = hot.withColumn("l_linenumber", F.when(F.col("l_orderkey") == 1, F.lit(1)).otherwise(F.col("l_linenumber")))
    paths = {"uniform": os.path.join(scratch, "uniform"), "hot": os.path.join(scratch, "hot")}
    for name, df in (("uniform", base), ("hot", hot)):
        if not os.path.exists(paths[name]):
            df.repartition(32).write.parquet(paths[name])
    for name, path in paths.items():
        t = spark.read.parquet(path)
        n = t.count()
        hot_rows = t.where((F.col("l_orderkey") == 1) & (F.col("l_linenumber") == 1)).count()
        print(f"== {name}: {n} rows, hot key rows {hot_rows} ({hot_rows / n:.0%})", flush=True)
        target = t.where(F.col("l_shipdate") < "1997-01-01")
        batch = dedup_latest(t.where(F.col("l_shipdate") >= "1996-06-01"), KEYS, ["l_shipdate"])
        jobs = {
            "dedup_latest": lambda: dedup_latest(t, KEYS, ["l_shipdate"]),
            "duplicate_keys": lambda: duplicate_keys(t, KEYS),
            "upsert_shuffle_path": lambda: upsert(target, batch, KEYS, max_broadcast_rows=0,
                                                  check_duplicates=False),
        }
        for job, build in jobs.items():
            before = set(stages(logs))
            t0 = time.time()
            build().write.format("noop").mode("overwrite").save()
            el = time.time() - t0
            time.sleep(1.0)
            st = stages(logs)
            new = {k: v for k, v in st.items() if k not in before}
            worst = max(new.items(), key=lambda kv: max(kv[1])) if new else (None, [0])
            print(f"   {job:22s} {el:6.1f}s  stages={len(new)}  "
                  f"slowest stage: tasks={len(worst[1])} max={max(worst[1]):.2f}s "
                  f"median={statistics.median(worst[1]):.2f}s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

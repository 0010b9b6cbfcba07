"""File maintenance: compaction planning and rewrite (M1), relocation (M3).

Rewrites never overwrite the path being read: data is written to a new
location, verified against the old one (R1), and only then does the caller
switch the table to it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lakewright.operators.checks import verify_equal
from lakewright.operators.sizing import broadcast_if_bounded
from lakewright.sinks.writers import FILE_NUMBER, _finish_merge, only_partitions, pending_path, seal_change
from lakewright.sources.files import file_inventory

# Fixed value: target size of a compacted data file.
TARGET_FILE_BYTES = 134_217_728


def compaction_plan(inventory: DataFrame, partition_columns: list[str],
                    target_bytes: int = TARGET_FILE_BYTES) -> DataFrame:
    """M1 plan: per partition, files and bytes now, files after a rewrite
    toward ``target_bytes``, and whether a rewrite would reduce the count."""
    g = inventory.groupBy(*partition_columns).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("rows").alias("rows"),
        F.sum("bytes").alias("bytes"))
    target = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(target_bytes))).cast("bigint")
    return g.select(*partition_columns, "files", "rows", "bytes",
                    target.alias("target_files"),
                    (F.col("files") > target).alias("needs_rewrite"))


def rewrite_groups(inventory: DataFrame, partition_columns: list[str],
                   target_bytes: int = TARGET_FILE_BYTES) -> DataFrame:
    """M1 plan by file: which files of a partition become one.

    Files are taken from the largest down, and a new group begins with every
    ``target_bytes`` of their running sum, so a group is below the target plus
    one file, and a file over the target stays alone.  Returns the inventory's
    columns with ``file_group`` (from 1, per partition), ``target_files`` and
    ``needs_rewrite`` (the partition would have fewer files).  It sorts one row
    per file of a partition; no data.
    """
    parts = list(partition_columns) or [F.lit(1)]
    ordered = Window.partitionBy(*parts).orderBy(F.desc("bytes"), "file_path")
    sums = F.sum("bytes").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    begun = F.floor(F.coalesce(sums, F.lit(0)) / F.lit(target_bytes))
    grouped = (inventory.withColumn("_begun", begun)
               .withColumn("file_group", F.dense_rank().over(Window.partitionBy(*parts).orderBy("_begun"))).drop("_begun"))
    whole = Window.partitionBy(*parts)
    return (grouped.withColumn("target_files", F.max("file_group").over(whole).cast("bigint"))
            .withColumn("needs_rewrite", F.count(F.lit(1)).over(whole) > F.col("target_files")))


def compact_table(spark: SparkSession, path: str, partition_columns: list[str],
                  target_bytes: int = TARGET_FILE_BYTES) -> DataFrame:
    """M1 on a stored table: rewrite the partitions that ``rewrite_groups``
    flags, each group of files into one file; others keep their files.

    The new content is staged beside the table with the number of its file,
    held against the old (R1, fingerprints), sealed, and copied over, a file's
    rows in one task; as for a merge, a later run on the path finishes what
    a lost driver left.  The map from file to group is broadcast only within the
    bounds of ``sizing``.  Returns (partition columns, files, target_files,
    needs_rewrite), one row per partition.
    """
    parts, staging = list(partition_columns), pending_path(path)
    _finish_merge(spark, path, staging, parts)
    table = spark.read.parquet(path)
    rewrite_groups(file_inventory(table, parts), parts, target_bytes).write.parquet(f"{staging}/plan")
    plan = spark.read.parquet(f"{staging}/plan")
    summary = plan.groupBy(*parts).agg(F.count(F.lit(1)).alias("files"), F.max("target_files").alias("target_files"),
                                       F.max("needs_rewrite").alias("needs_rewrite"))
    result = spark.createDataFrame(summary.collect(), summary.schema)          # one row per partition
    todo = plan.where("needs_rewrite")
    flagged = [r for r in result.collect() if r["needs_rewrite"]]
    if not flagged:
        _finish_merge(spark, path, staging, parts)
        return result
    number = F.dense_rank().over(Window.orderBy(*parts, "file_group")) - 1     # over files, not rows
    numbered = todo.select("file_path", number.cast("int").alias(FILE_NUMBER))
    files = 1 + numbered.agg(F.max(FILE_NUMBER)).first()[0]
    groups, _ = broadcast_if_bounded(numbered)
    old = only_partitions(table.select("*", F.col("_metadata.file_path").alias("file_path")), parts, flagged)
    (old.join(groups, "file_path").drop("file_path").write.option("compression", "zstd").parquet(f"{staging}/data"))
    kinds = StructType(table.schema.fields + [StructField(FILE_NUMBER, IntegerType())])
    new = spark.read.schema(kinds).parquet(f"{staging}/data").drop(FILE_NUMBER)
    check = verify_equal(old.join(groups, "file_path", "left_semi").drop("file_path"), new, method="fingerprint").first()
    if not check["equal"]:
        raise RuntimeError(f"the staged rewrite of {path} differs: {check.asDict()}")
    touched = result.where("needs_rewrite").select(*parts, F.lit(True).alias("kept"))
    seal_change(touched, staging, table.schema, files)
    _finish_merge(spark, path, staging, parts)
    return result


def compact(spark: SparkSession, df: DataFrame, new_path: str,
            partition_columns: list[str] | None = None,
            target_bytes: int = TARGET_FILE_BYTES) -> DataFrame:
    """M1 rewrite: write ``df`` to ``new_path`` in files near ``target_bytes``
    and return the R1 verification of the new files against ``df``.

    ``REBALANCE`` (by the partition columns, if any) lets AQE cut the
    shuffle output into partitions of the advisory size, so each task writes
    one file of about the target size per partition value.
    """
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(target_bytes))
    try:
        parts = list(partition_columns or [])
        out = df.hint("rebalance", *parts)
        writer = out.write.mode("errorifexists").option("compression", "zstd")
        if parts:
            writer = writer.partitionBy(*parts)
        writer.parquet(new_path)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    written = spark.read.schema(df.schema).parquet(new_path).select(*df.columns)
    return verify_equal(df, written, method="fingerprint")


_URI = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://")


def same_location(a: str | None, b: str | None) -> bool:
    """Compare two locations as the catalog stores them: ``file:///x`` and
    ``file:/x`` (an empty authority) are the same place."""
    if a is None or b is None:
        return False
    norm = lambda u: re.sub(r"^([a-zA-Z][a-zA-Z0-9+.-]*):///", r"\1:/", u.rstrip("/"))
    return norm(a) == norm(b)


def table_location(spark: SparkSession, table: str) -> str | None:
    """Location from the table metadata (the detail section of DESCRIBE,
    so a data column named ``Location`` cannot shadow it)."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(table)}").collect()
    in_detail = False
    for r in rows:
        if (r.col_name or "").startswith("# Detailed Table Information"):
            in_detail = True
        elif in_detail and r.col_name == "Location":
            return r.data_type
    return None


def _partition_spec(path_part: str) -> str:
    """``day=1/hour=%3A`` -> ``day = '1', hour = ':'`` (values unescaped)."""
    from urllib.parse import unquote
    items = []
    for kv in path_part.split("/"):
        k, v = kv.split("=", 1)
        v = unquote(v).replace("\\", "\\\\").replace("'", "\\'")
        items.append(f"`{unquote(k).replace('`', '``')}` = '{v}'")
    return ", ".join(items)


def _quoted(table: str) -> str:
    """A table name as the catalog has it, each part quoted."""
    return ".".join("`" + p.strip("`").replace("`", "``") + "`" for p in table.split("."))


def _external(spark: SparkSession, table: str) -> bool:
    return (spark.catalog.getTable(table).tableType or "").upper() == "EXTERNAL"


SPECS = 1_000            # partitions forgotten by one statement


def relocate(spark: SparkSession, table: str, new_location: str,
             method: str = "fingerprint") -> DataFrame:
    """M3: point a table at a new location holding the same data.

    Refused when the location is not a URI (``scheme://...``), or when the
    data there differs from the table's current data (R1): after SET
    LOCATION to an empty path a table silently has 0 rows.  Then the table
    location is set.  The partitions of an external table are forgotten,
    SPECS at a time, which leaves their files, and found again under the new
    location by one call; those of a managed table, which would lose its files
    so, are pointed at their folders one by one.  A run that ended between the
    two is taken up by calling again: a table already at the location finds its
    partitions first.  The location is re-read from the catalog, and the table
    as the catalog now reads it is compared with the new data once more.
    ``method`` is R1's: ``fingerprint`` (default: no shuffle, one pass over
    each copy) or ``exact``.  Returns the one-row verification.
    """
    if not _URI.match(new_location):
        raise ValueError(f"new location must be a URI such as hdfs://... or file:///...: {new_location}")
    name = _quoted(table)
    part_cols = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    if part_cols and same_location(table_location(spark, table), new_location):
        spark.catalog.recoverPartitions(table)
    current = spark.table(table)
    moved = (spark.read.option("basePath", new_location).schema(current.schema)
             .parquet(new_location).select(*current.columns))
    check = verify_equal(current, moved, method=method).collect()[0]
    if not check["equal"]:
        raise ValueError(f"data at {new_location} differs from {table}: {check.asDict()}")
    place = new_location.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{place}'")
    if part_cols:
        known = [r[0] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]       # one row per partition
        if _external(spark, table):
            for i in range(0, len(known), SPECS):
                specs = ", ".join(f"PARTITION ({_partition_spec(p)})" for p in known[i:i + SPECS])
                spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {specs}")
            spark.catalog.recoverPartitions(table)
        else:
            for p in known:
                spark.sql(f"ALTER TABLE {name} PARTITION ({_partition_spec(p)}) SET LOCATION '{place.rstrip('/')}/{p}'")
    spark.catalog.refreshTable(table)
    now = table_location(spark, table)
    if not same_location(now, new_location):
        raise RuntimeError(f"location not updated: {now}")
    after = verify_equal(spark.table(table), moved, method=method).collect()[0]
    if not after["equal"]:
        raise RuntimeError(f"{table} at its new location reads differently: {after.asDict()}")
    return spark.createDataFrame([(table, now, check["left_rows"], True)],
                                 "table_name string, location string, rows bigint, verified boolean")

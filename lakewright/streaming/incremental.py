"""Incremental load into a change log with Structured Streaming.

The reference leaves the high-water mark to its caller.  Here the stream
keeps it: a file source remembers which files it has read in its checkpoint,
and ``trigger(availableNow=True)`` processes everything new, then stops --
a batch job that picks up where the previous run ended.

Each micro-batch becomes one commit of an append-only change log
(partition ``commit_id = batch id``), written with dynamic partition
overwrite.  A batch replayed after a failure rewrites the same partition,
so the load is idempotent; the table state is ``state_as_of`` over the log
read back with ``read_change_log``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_change_log(spark: SparkSession, log_path: str) -> DataFrame:
    """The change log written by ``incremental_load``, with ``commit_id`` as
    BIGINT.  Partition values are read as strings (so ``'10' < '2'``); the
    cast restores numeric commit order, and filters on it still prune
    partitions."""
    return spark.read.parquet(log_path).withColumn("commit_id", F.col("commit_id").cast("bigint"))


def _has_table(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a table.  Only "no such path" and "no data file"
    mean no; any other error is raised, never taken for an empty table."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def _commit_writer(log_path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        out = batch.withColumn("commit_id", F.lit(batch_id).cast("bigint"))
        # A replayed batch keeps the time of its first commit.
        first = (read_change_log(spark, log_path).where(F.col("commit_id") == batch_id)
                 .agg(F.min("committed_at")).first()[0] if _has_table(spark, log_path) else None)
        out = out.withColumn("committed_at", F.lit(first) if first else F.current_timestamp())
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("compression", "zstd").partitionBy("commit_id").parquet(log_path))
    return write


def _merge_writer(target_path: str, keys: list[str], partition_columns: list[str],
                  op_column: str | None, order_by: list[str] | None):
    def write(batch: DataFrame, batch_id: int) -> None:
        from lakewright.operators.merge import duplicate_keys
        from lakewright.operators.transform import dedup_latest
        from lakewright.sinks.writers import merge_into_path, write_table
        spark = batch.sparkSession
        if order_by:
            # Several versions of a key in one batch: the newest wins.
            batch = dedup_latest(batch, keys, order_by)
        if _has_table(spark, target_path):
            merge_into_path(batch, target_path, keys, partition_columns, op_column=op_column)
        else:
            several = duplicate_keys(batch, keys).take(1)
            if several:
                raise ValueError(f"source has several rows for one target key: {several[0]}")
            new = batch
            if op_column:
                new = batch.where(~F.coalesce(F.col(op_column) == "D", F.lit(False))).drop(op_column)
            write_table(new, target_path, "overwrite", partition_columns)
    return write


def incremental_load(spark: SparkSession, source_path: str, schema: StructType, log_path: str,
                     checkpoint: str | None = None, fmt: str = "parquet",
                     max_files_per_trigger: int | None = None,
                     merge_keys: list[str] | None = None,
                     partition_columns: list[str] | None = None,
                     op_column: str | None = None,
                     order_by: list[str] | None = None) -> int:
    """Load files that arrived under ``source_path`` since the last run.

    By default each micro-batch becomes one commit of the change log at
    ``log_path``.  With ``merge_keys`` the batch is instead upserted into
    the table at ``log_path`` (only touched partitions are rewritten);
    replaying a batch gives the same table.  Several rows of one key in a
    batch are an error unless ``order_by`` says which one is newest.
    Returns the number of micro-batches that carried rows."""
    # Beside the table it belongs to: the next application finds it there.
    checkpoint = checkpoint or f"{log_path.rstrip('/')}_progress"
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_path)
    writer = (_merge_writer(log_path, merge_keys, list(partition_columns or []), op_column, order_by)
              if merge_keys else _commit_writer(log_path))
    carried = []

    def counted(batch: DataFrame, batch_id: int) -> None:
        if batch.take(1):
            carried.append(batch_id)
        writer(batch, batch_id)
    q = (stream.writeStream.foreachBatch(counted)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return len(set(carried))

"""File sources (S6-S9) and the file inventory.

Readers take explicit schemas: inference costs an extra pass over the data
and turns CSV into all-strings and dict rows into name-sorted columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_text(spark: SparkSession, path: str, wholetext: bool = False) -> DataFrame:
    """One row per line (``value``), or one row per file with ``wholetext``."""
    return spark.read.text(path, wholetext=wholetext)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None,
              multiline: bool = False, **options: str) -> DataFrame:
    """JSON lines (or one multi-line document per file)."""
    reader = spark.read.option("multiLine", multiline).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet, optionally with a declared schema."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             header: bool = True, **options: str) -> DataFrame:
    """CSV with a header row; without a schema every column is a string."""
    reader = spark.read.option("header", header).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def list_objects(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """S10 (listing): every object under ``path``, of any format: path, name,
    bytes, modification time.

    The ``binaryFile`` source lists files in parallel on the cluster and
    reads no content when ``content`` is not selected.  The object count and
    the first names are ``count()`` and ``orderBy("name").limit(n)`` on it.
    """
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
          .load(path))
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"),
                     F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def listing_summary(objects: DataFrame, n: int = 5) -> DataFrame:
    """S10 summary: number of objects and the first ``n`` names (sorted).

    A partial count and a per-task top-n; the two one-row results are
    combined by a grouping, not a join, and no unbounded list is collected.
    """
    count = objects.agg(F.count(F.lit(1)).alias("objects")).select(
        "objects", F.lit(None).cast("array<string>").alias("first_names"))
    first = (objects.select("name").orderBy("name").limit(n)
             .agg(F.array_sort(F.collect_list("name")).alias("first_names"))
             .select(F.lit(None).cast("bigint").alias("objects"), "first_names"))
    return count.unionByName(first).agg(F.max("objects").alias("objects"),
                                         F.max("first_names").alias("first_names"))


def file_inventory(df: DataFrame, partition_columns: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row per data file: partition values, name, rows, bytes.

    Uses the hidden ``_metadata`` column of file sources, so no data column
    is read; the per-file row count is a partial aggregate (map-side), so a
    file or partition holding most rows does not land in one task whole.
    """
    keys = [F.col(c) for c in partition_columns]
    return (
        df.select(*keys,
                  F.col("_metadata.file_path").alias("file_path"),
                  F.col("_metadata.file_name").alias("file_name"),
                  F.col("_metadata.file_size").alias("file_size"))
        .groupBy(*partition_columns, "file_path", "file_name")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("file_size").alias("bytes"))
    )


def partition_inventory(df: DataFrame, partition_columns: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """S10 rolled up per partition: files, rows, bytes."""
    return (file_inventory(df, partition_columns)
            .groupBy(*partition_columns)
            .agg(F.count(F.lit(1)).alias("files"),
                 F.sum("rows").alias("rows"),
                 F.sum("bytes").alias("bytes")))

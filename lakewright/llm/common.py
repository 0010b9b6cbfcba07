"""Helpers shared by the operators: input normalisation and staged tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.session import require_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; they
    need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="lakewright-")         # the driver serves it from here
        sc.addPyFile(shutil.make_archive(f"{folder}/{package.name}_package", "zip", package.parent, package.name))
        _SHIPPED.add(sc.applicationId)


def docs_of(df: DataFrame, *extra: str) -> DataFrame:
    """``doc_id`` (long), ``text`` (null counts as empty) and the named extra
    columns.  Every other column of the input is left behind, so no name an
    operator uses inside can clash with one of the caller's."""
    ship(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                     *[F.col(c) for c in extra])


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir`` and
    read it back: cuts the lineage, survives a lost executor, and makes
    every later reader see the same rows."""
    spark = df.sparkSession
    path = f"{require_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

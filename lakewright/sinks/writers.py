"""Table and file writers.

* ``write_table``: append (K1) or overwrite of only the partitions present
  in the data (K2); any other mode is refused (K3).  Columns are matched by
  name against the table schema first (P8).
* ``create_table``: create-if-missing partitioned parquet table (K4).
* ``write_verified``: JSON / parquet / CSV / text write, read back with the
  same schema and compared row for row (K5-K7 + R1).
* ``save_report``: one report row as JSON in a timestamped folder (K8).
* ``insert_into``: positional catalog insert after conforming (K9).
"""

from __future__ import annotations

import datetime as _dt
import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from lakewright.functions.columns import sql_type
from lakewright.operators.checks import fingerprint_sums, verify_equal
from lakewright.operators.transform import conform_schema
from lakewright.sources.files import list_objects, read_csv, read_json, read_parquet, read_text

WRITE_MODES = ("append", "overwrite")
FORMATS = ("json", "parquet", "csv", "text")

# Timestamp text formats for JSON/CSV.  Spark's defaults keep
# milliseconds only, which silently drops the microseconds of a timestamp.
TEXT_TIMESTAMP_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def write_table(df: DataFrame, path: str, mode: str = "append",
                partition_columns: list[str] | None = None,
                schema: StructType | None = None, rebalance: bool = True) -> None:
    """K1/K2/K3: write ``df`` to a parquet table at ``path``.

    ``append`` adds files; ``overwrite`` replaces only the partitions that
    occur in ``df`` (dynamic partition overwrite), never the whole table.

    A partitioned write is preceded by ``REBALANCE(partition columns)``:
    rows of one partition value go to few tasks (no task writes a small file
    into every partition), and AQE splits a partition value that holds a
    large share of the rows into several tasks instead of one.
    """
    if mode not in WRITE_MODES:
        raise ValueError(f"write mode is {mode!r}, but only {' and '.join(map(repr, WRITE_MODES))} exist")
    if schema is not None:
        df = conform_schema(df, schema)
    if partition_columns and rebalance:
        df = df.hint("rebalance", *partition_columns)
    w = df.write.mode(mode).option("compression", "zstd")
    if mode == "overwrite":
        w = w.option("partitionOverwriteMode", "dynamic")
    if partition_columns:
        w = w.partitionBy(*partition_columns)
    w.parquet(path)


FILE_NUMBER = "_file"    # of a staged row, in a change that settles the files of the target

# How partition directories name NULL and escape characters.
_NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
_PATH_ESCAPES = set('"#%\'*/:=?\\\x7f{[]^')


def _escape_path_name(v: str) -> str:
    return "".join(f"%{ord(ch):02X}" if ch in _PATH_ESCAPES or ord(ch) < 0x20 else ch for ch in v)


def _partition_dir_value(v) -> str:
    return _NULL_PARTITION if v is None or v == "" else _escape_path_name(str(v))


def _delete_path(spark: SparkSession, path: str) -> None:
    """Remove a directory through the cluster's Hadoop file system (driver
    side, one call per path: metadata, not data)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def pending_path(target_path: str) -> str:
    """Where a change of a stored table is staged: beside the table, under a
    name that only depends on the table's, so that any later application
    finds what a lost one left."""
    return f"{target_path.rstrip('/')}_pending"


def read_if_there(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The parquet table at ``path``; None if there is no such path or no data
    file in it.  Any other error is raised."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def seal_change(touched: DataFrame, staging: str, schema: StructType, files: int = 0) -> None:
    """Seal a staged change: from here on it is carried out, by this or by a
    later application.  ``touched`` has the partition values and ``kept``;
    ``files`` says that the staged rows carry the number of their file."""
    (touched.select("*", F.lit(schema.json()).alias("target_schema"), F.lit(files).alias("files"))
     .coalesce(1).write.parquet(f"{staging}/ready"))


def _finish_merge(spark: SparkSession, target_path: str, staging: str, parts: list[str]) -> list | None:
    """Copy a completely staged change over its target and drop the staging;
    None if there is none.  Every step can be run again."""
    sealed = read_if_there(spark, f"{staging}/ready")
    if sealed is None:
        _delete_path(spark, staging)                                    # staged in part only
        return None
    ready = sealed.collect()                                            # one row per touched partition value
    schema, files = StructType.fromJson(json.loads(ready[0]["target_schema"])), ready[0]["files"]
    if files:
        data = spark.read.schema(StructType(schema.fields + [StructField(FILE_NUMBER, IntegerType())])).parquet(f"{staging}/data")
        write_table(data.repartitionById(files, FILE_NUMBER).drop(FILE_NUMBER), target_path, "overwrite", parts, rebalance=False)
    else:
        write_table(spark.read.schema(schema).parquet(f"{staging}/data"), target_path, "overwrite", parts)
    for r in ready:
        if not r["kept"]:
            sub = "/".join(f"{_escape_path_name(c)}={_partition_dir_value(r[c])}" for c in parts)
            _delete_path(spark, f"{target_path.rstrip('/')}/{sub}")
    _delete_path(spark, f"{staging}/ready")
    _delete_path(spark, staging)
    return ready


def only_partitions(df: DataFrame, parts: list[str], rows: list, types: StructType | None = None) -> DataFrame:
    """``df`` narrowed to about the partitions of ``rows`` by literals, which
    the scan uses to list no others."""
    for c in parts:
        if types is None or types[c].dataType == df.schema[c].dataType:
            df = df.where(df[c].isin(sorted({r[c] for r in rows} - {None})) | df[c].isNull())
    return df


def merge_into_path(source: DataFrame, target_path: str, keys: list[str],
                    partition_columns: list[str], update_columns: list[str] | None = None,
                    op_column: str | None = None, staging_path: str | None = None) -> DataFrame:
    """J1-J3 written back to a partitioned parquet table, rewriting only the
    partitions the batch touches.

    Touched partitions are those of the batch rows plus those of target
    rows whose key the batch matches (an update may move a row to another
    partition); only they are read.  Their new content is written to a
    folder beside the target first (the target is never overwritten while it
    is read), sealed by a ``ready`` table, then copied over the target with
    dynamic partition overwrite; touched partitions left without rows are
    removed.  The folder's name follows from the target's: a merge, of any
    application, first finishes a sealed one that a lost driver left behind
    and drops an unsealed one, so a rerun gives the same table.
    One merge at a time may run on a target.  Returns the touched partition
    values with a ``kept`` flag (False = the partition is now empty and was
    removed).
    """
    from lakewright.operators.merge import upsert
    from lakewright.operators.sizing import DEFAULT_MAX_BROADCAST_ROWS

    spark = source.sparkSession
    parts = list(partition_columns)
    staging = staging_path or pending_path(target_path)
    _finish_merge(spark, target_path, staging, parts)
    target = spark.read.parquet(target_path)
    if not parts:
        # Unpartitioned: the whole table is the one touched partition.
        new = upsert(target, source, keys, update_columns=update_columns, op_column=op_column)
        write_table(new.select(*target.columns), f"{staging}/data", "overwrite")
        one = spark.createDataFrame([(True,)], "kept boolean")
        seal_change(one, staging, target.schema)
        _finish_merge(spark, target_path, staging, parts)
        return one
    src_keys = source.select(*keys).distinct()
    hit = target.select(*keys, *parts).join(src_keys, keys, "left_semi").select(*parts)
    touched = source.select(*parts).unionByName(hit).distinct()
    touched_rows = touched.collect()          # one row per partition value
    if not touched_rows:
        return touched.withColumn("kept", F.lit(True))
    small = len(touched_rows) <= DEFAULT_MAX_BROADCAST_ROWS
    tb = F.broadcast(touched) if small else touched
    # NULL-safe: a NULL partition value is a partition like any other.
    same_part = reduce(lambda a, b: a & b, [target[c].eqNullSafe(tb[c]) for c in parts])
    near = only_partitions(target, parts, touched_rows, touched.schema)
    old = near.join(tb, same_part, "left_semi")
    new = upsert(old, source, keys, update_columns=update_columns, op_column=op_column)
    write_table(new.select(*target.columns), f"{staging}/data", "overwrite", parts)
    staged = spark.read.schema(target.schema).parquet(f"{staging}/data")
    kept = {tuple(r) for r in staged.select(*parts).distinct().collect()}
    schema = StructType(touched.schema.fields + [StructField("kept", BooleanType(), False)])
    result = spark.createDataFrame([(*tuple(r), tuple(r) in kept) for r in touched_rows], schema)
    seal_change(result, staging, target.schema)
    _finish_merge(spark, target_path, staging, parts)
    return result


def append_once(df: DataFrame, path: str, run_id: str, partition_columns: list[str] | None = None) -> int:
    """K1 that can be run again: append ``df`` to the table at ``path`` once for
    ``run_id``, whatever happened to earlier attempts; returns the rows added.

    The files there are before the append are noted beside the table first.
    An attempt that finds such a note without its end removes the files that
    have come since, and appends anew; one that finds the end adds nothing.
    One writer at a time may work on a table.
    """
    spark = df.sparkSession
    run = f"{path.rstrip('/')}_runs/{run_id}"
    done = read_if_there(spark, f"{run}/done")
    if done is not None:
        return done.first()["rows"]
    note = read_if_there(spark, f"{run}/before")
    now = _data_files(spark, path)
    if note is None:
        now.coalesce(1).write.mode("overwrite").parquet(f"{run}/before")
    else:
        for r in now.join(note, "path", "left_anti").collect():         # the files of one broken append
            _delete_path(spark, r["path"])
    seen = Observation("appended")
    if partition_columns:
        df = df.hint("rebalance", *partition_columns)
    write_table(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, "append", partition_columns, rebalance=False)
    rows = int(seen.get["rows"])
    spark.createDataFrame([(run_id, rows)], "run_id string, rows long").coalesce(1).write.mode("overwrite").parquet(f"{run}/done")
    return rows


def _data_files(spark: SparkSession, path: str) -> DataFrame:
    try:
        return list_objects(spark, path).where("name like '%.parquet'").select("path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string")


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def create_table(spark: SparkSession, name: str, schema: StructType, location: str,
                 partition_columns: list[str] | None = None,
                 comment: str | None = None) -> bool:
    """K4: ``CREATE TABLE IF NOT EXISTS`` a parquet table at ``location``.

    Returns True when the table was created, False when it existed.  Types
    keep their full DDL name (decimal precision, nested types).  The
    comment is passed as a quoted literal, never pasted into the text raw.
    """
    if spark.catalog.tableExists(name):
        return False
    cols = ", ".join(f"{_quote(f.name)} {sql_type(f.dataType)}" for f in schema.fields)
    parts = f"PARTITIONED BY ({', '.join(_quote(c) for c in partition_columns)})" if partition_columns else ""
    note = ""
    if comment:
        note = "COMMENT '" + comment.replace("\\", "\\\\").replace("'", "\\'") + "'"
    loc = location.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet "
              f"OPTIONS ('compression' = 'zstd') {parts} {note} LOCATION '{loc}'")
    return True


def write_verified(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                   method: str = "exact") -> DataFrame:
    """K5-K7 (+ text) with R1: write, read back with the same schema and
    compare.  Returns one row: left_rows (written), right_rows (read back),
    and ``equal``; a write that loses or changes rows is not equal.  JSON
    and CSV carry timestamps with microseconds (Spark's default text format
    would cut them to milliseconds, which this check would report).

    ``method="observed"`` takes the sums of the row fingerprints while the rows
    are written, in the writing tasks, so the source is read once; they are
    held against the sums of the rows read back.  The other methods of
    ``verify_equal`` read the source a second time."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}: use one of {FORMATS}")
    if fmt == "text" and [f.dataType.simpleString() for f in df.schema.fields] != ["string"]:
        raise ValueError("the text format takes exactly one string column")
    spark = df.sparkSession
    w = df.write.mode(mode)
    read = df.columns
    if method == "observed":
        seen = Observation("written")
        w = df.observe(seen, *fingerprint_sums(df)).write.mode(mode)
    if fmt == "csv":
        w.options(**TEXT_TIMESTAMP_OPTIONS).option("header", True).csv(path)
        back = read_csv(spark, path, df.schema, header=True, **TEXT_TIMESTAMP_OPTIONS)
    elif fmt == "json":
        w.options(**TEXT_TIMESTAMP_OPTIONS).json(path)
        back = read_json(spark, path, df.schema, **TEXT_TIMESTAMP_OPTIONS)
    elif fmt == "text":
        w.text(path)
        back = read_text(spark, path).toDF(*df.columns)
    else:
        w.option("compression", "zstd").parquet(path)
        back = read_parquet(spark, path, df.schema)
    if method == "observed":
        got = back.select(*read).agg(*fingerprint_sums(df)).first().asDict()
        put = seen.get
        equal = all(put[k] == got[k] for k in got)
        return spark.createDataFrame([(put["n"], got["n"], equal)], "left_rows bigint, right_rows bigint, equal boolean")
    return verify_equal(df, back.select(*read), method=method)


def save_report(report: DataFrame, output_path: str, prefix: str = "report",
                now: _dt.datetime | None = None) -> str:
    """K8: write report rows as JSON into ``<output_path>/<prefix>_<utc time>``.

    JSON lines, not pretty-printed text, so the report reads back as rows.
    A report is one row per run, so a single file is written.
    """
    stamp = (now or _dt.datetime.now(_dt.timezone.utc)).strftime("%Y%m%d_%H%M%S")
    full = f"{output_path.rstrip('/')}/{prefix}_{stamp}"
    report.coalesce(1).write.mode("overwrite").json(full)
    return full


def insert_into(df: DataFrame, table: str) -> None:
    """K9: append into a catalog table.  ``insertInto`` is positional, so the
    rows are first conformed by name to the table's columns."""
    spark = df.sparkSession
    target = spark.table(table).schema
    df = conform_schema(df, target)
    df.write.insertInto(table)

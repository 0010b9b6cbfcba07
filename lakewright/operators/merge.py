"""Upsert with composite keys and deletes.

MERGE semantics on DataFrames:

* matched target rows take the source values of ``update_columns``
  (default: every source column);
* unmatched source rows are inserted; target columns the source lacks are
  NULL; a source column the target lacks is refused;
* target-only rows stay;
* keys compare with ``=``: a NULL key never matches, so NULL-key source rows
  are inserted and NULL-key target rows stay, each on its own;
* with ``op_column``, a source row with op 'D' removes its matched target
  row and is never inserted;
* two source rows for one key are an error (checked first by default).

Plan choice.  A change batch is usually small next to the table.  The batch
is profiled in one job -- rows, measured bytes, and (for the duplicate
check) the largest number of rows sharing a key.  When rows and bytes are
within bounds the batch is broadcast and the target is read in place by a
left join, never shuffled; inserts are the batch rows whose key is not
among the matched keys (at most one row per batch key, broadcast back).
Beyond the bounds both sides are shuffled on the keys for the same left
join, and inserts are the batch rows without a key among the target's
distinct keys (a keys-only shuffle of the target, pre-aggregated per task,
so a hot key is one row per task).  No full outer join is used:
AQE can split a skewed target key partition of a left join, not of a full
outer one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.operators.sizing import (
    DEFAULT_MAX_BROADCAST_BYTES, DEFAULT_MAX_BROADCAST_ROWS, measure, row_bytes,
)

_S = "__src_"          # prefix of source columns inside the join
DELETE_OP = "D"


def _keys(keys: str | list[str]) -> list[str]:
    if isinstance(keys, str):
        if "," in keys:
            raise ValueError("pass a composite key as a list of column names")
        return [keys]
    return list(keys)


def duplicate_keys(df: DataFrame, keys: str | list[str]) -> DataFrame:
    """Keys that occur more than once, with their count ``n``.

    ``groupBy().count()`` is aggregated map-side first, so a hot key costs
    one row per task in the shuffle.
    """
    ks = _keys(keys)
    return (df.groupBy(*ks).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def assert_unique_keys(df: DataFrame, keys: str | list[str]) -> None:
    """Raise when two rows of ``df`` share a non-NULL key (MERGE's rule)."""
    ks = _keys(keys)
    notnull = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in ks])
    dup = duplicate_keys(df.where(notnull), ks).limit(1).collect()
    if dup:
        raise ValueError(f"source has several rows for one target key: {dup[0].asDict()}")


def _profile(source: DataFrame, ks: list[str], check_duplicates: bool,
             max_rows: int) -> tuple[int, int, int]:
    """(rows, bytes, largest group of one non-NULL key) in one job.

    With the duplicate check the batch is grouped by key (partial counts
    map-side, so a hot key is one row per task); without it the rows are only
    counted and measured.
    """
    size = row_bytes(source).alias("__b")
    if not check_duplicates:
        rows, nbytes = measure(source, max_rows)
        return rows, nbytes, 1
    notnull = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in ks])
    per_key = (source.select(*ks, size, notnull.alias("__nn"))
               .groupBy(*ks, "__nn").agg(F.count(F.lit(1)).alias("n"), F.sum("__b").alias("b")))
    r = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                    F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"),
                    F.coalesce(F.max(F.when(F.col("__nn"), F.col("n"))), F.lit(0)).alias("dup")).first()
    return int(r["rows"]), int(r["bytes"]), int(r["dup"])


def _cond(t: DataFrame, s: DataFrame, ks: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [t[k] == s[_S + k] for k in ks])


def upsert(target: DataFrame, source: DataFrame, keys: str | list[str],
           update_columns: list[str] | None = None, op_column: str | None = None,
           check_duplicates: bool = True,
           max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
           max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
           materialize: bool = False) -> DataFrame:
    """The target's new state after merging ``source`` into it.

    The batch is read up to three times (profile, join, inserts).  When it
    is itself expensive (an aggregate, a join), ``materialize=True`` writes
    it once with ``checkpoint()`` into the shared checkpoint folder, which
    also cuts its lineage.
    """
    ks = _keys(keys)
    if materialize:
        from lakewright.session import checkpoint_dir
        checkpoint_dir(source.sparkSession)
        source = source.checkpoint(eager=True)
    src_cols = [c for c in source.columns if c != op_column]
    missing_keys = [k for k in ks if k not in target.columns or k not in src_cols]
    if missing_keys:
        raise ValueError(f"merge key missing on one side: {missing_keys}")
    unknown = [c for c in src_cols if c not in target.columns]
    if unknown:
        raise ValueError(f"source columns the target lacks: {unknown}")
    updates = list(src_cols if update_columns is None else update_columns)
    bad = [c for c in updates if c not in src_cols]
    if bad:
        raise ValueError(f"update columns not in the source: {bad}")
    rows, nbytes, largest = _profile(source, ks, check_duplicates, max_broadcast_rows)
    if largest > 1:
        raise ValueError(f"source has several rows for one target key ({largest} rows share a key)")

    s = source.select(*[F.col(c).alias(_S + c) for c in source.columns])
    is_delete = (F.coalesce(F.col(_S + op_column) == DELETE_OP, F.lit(False))
                 if op_column else F.lit(False))
    # Keys never match when NULL, so a matched row has a non-NULL batch key.
    hit = F.col(_S + ks[0]).isNotNull()

    small = rows <= max_broadcast_rows and nbytes <= max_broadcast_bytes
    t = target
    j = t.join(F.broadcast(s) if small else s, _cond(t, s, ks), "left")
    updated = j.where(~(hit & is_delete)).select(*[
        (F.when(hit, F.col(_S + c)).otherwise(t[c]) if c in updates else t[c]).alias(c)
        for c in target.columns])
    s_key_cols = [_S + k for k in ks]
    if small:
        # Batch keys found in the target (a keys-only read of the target),
        # at most one row per batch key, broadcast back to the batch.
        matched = j.where(hit).select(*[F.col(c) for c in s_key_cols]).distinct()
        ins = s.join(F.broadcast(matched), s_key_cols, "left_anti")
    else:
        # The target's distinct keys (partial per task, so a hot key is one
        # row per task).
        tkeys = target.select(*[F.col(k).alias(_S + k) for k in ks]).distinct()
        ins = s.join(tkeys, s_key_cols, "left_anti")
    inserted = ins.where(~is_delete).select(*[
        (F.col(_S + c) if c in src_cols else F.lit(None).cast(target.schema[c].dataType)).alias(c)
        for c in target.columns])
    return updated.unionByName(inserted)

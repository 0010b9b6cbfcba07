"""Governed scans and access audits.

The managed platform filters rows and columns on read for a principal.
Here a policy is explicit and applied as ordinary DataFrame operators, so
Catalyst pushes the row predicate into the scan and prunes hidden columns
from the read schema.  This is a convenience view, not a security
boundary: code running in the same session can read the table directly.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.operators.sizing import (
    DEFAULT_MAX_BROADCAST_BYTES, DEFAULT_MAX_BROADCAST_ROWS, fits_broadcast,
)

# Permission names and the database-level table marker.
SELECT = "SELECT"
DESCRIBE = "DESCRIBE"
ALL_TABLES = "*"


@dataclass(frozen=True)
class Policy:
    """What one principal may see of one table."""
    principal: str
    row_filter: str | None = None                 # SQL predicate text, trusted
    allowed_columns: tuple[str, ...] | None = None  # None = all top-level columns
    hidden_columns: tuple[str, ...] = field(default_factory=tuple)


def apply_row_policy(df: DataFrame, predicate: str | Column | None) -> DataFrame:
    """G1, predicate form.  Applied before any caller filter."""
    if predicate is None:
        return df
    return df.where(F.expr(predicate) if isinstance(predicate, str) else predicate)


def entitled_rows(df: DataFrame, entitlements: DataFrame, on: list[tuple[str, str]] | list[str],
                  max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                  max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """G1, list form: rows whose key is in the principal's entitlement list.

    ``on`` pairs a table column with an entitlement column (or names a
    column present in both).  The list is reduced to its distinct keys and
    broadcast when it is within the row bound; otherwise it is a shuffled
    semi join.  A semi join never duplicates table rows.  The size probe
    reads the key columns of the whole list once, a row per task comes back.
    """
    pairs = [(c, c) if isinstance(c, str) else c for c in on]
    raw = entitlements.select(*[F.col(e).alias(f"__ent_{i}") for i, (_, e) in enumerate(pairs)])
    # The raw list is measured; its distinct keys are no larger.
    ent = raw.distinct()
    if fits_broadcast(raw, max_broadcast_rows, max_broadcast_bytes):
        ent = F.broadcast(ent)
    cond = reduce(lambda a, b: a & b,
                  [df[t] == ent[f"__ent_{i}"] for i, (t, _) in enumerate(pairs)])
    return df.join(ent, cond, "left_semi")


def apply_column_policy(df: DataFrame, allowed: list[str] | tuple[str, ...] | None = None,
                        hidden: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Keep permitted top-level columns in table order.

    Policies on nested fields (dotted names) are refused: only top-level
    columns can be granted.
    """
    names = list(allowed or []) + list(hidden)
    nested = [c for c in names if "." in c]
    if nested:
        raise ValueError(f"column policies on nested fields are not supported: {nested}")
    keep = [c for c in df.columns
            if (allowed is None or c in allowed) and c not in hidden]
    return df.select(*keep)


def governed_scan(df: DataFrame, policy: Policy) -> DataFrame:
    """G1 + G2: row filter first, then the permitted columns."""
    out = apply_row_policy(df, policy.row_filter)
    return apply_column_policy(out, policy.allowed_columns, policy.hidden_columns)


def resolve_grants(requests: DataFrame, grants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split access requests into (allowed, denied).

    A request (principal, database_name, table_name, permission) is allowed
    when the same grant exists.  Reading a table asks for SELECT on the
    table and DESCRIBE on its database (``table_name = '*'``); a request
    without a matching grant is denied.  Grants are made distinct first, so
    the semi/anti joins never multiply request rows; AQE broadcasts the
    grants when they are small and splits skewed request partitions.
    """
    cols = ["principal", "database_name", "table_name", "permission"]
    g = grants.select(*cols).distinct()
    allowed = requests.join(g, cols, "left_semi")
    denied = requests.join(g, cols, "left_anti")
    return allowed, denied


def read_requests(reads: DataFrame) -> DataFrame:
    """Expand table reads (principal, database_name, table_name, ...) into the
    grant requests they need: SELECT on the table and DESCRIBE on its
    database.  One scan of ``reads`` emits both rows per read (``explode``
    of a two-element array), instead of a union that reads it twice.
    Other columns of ``reads`` (a request id) are kept."""
    need = F.array(
        F.struct(F.col("table_name").alias("t"), F.lit(SELECT).alias("p")),
        F.struct(F.lit(ALL_TABLES).alias("t"), F.lit(DESCRIBE).alias("p")))
    rest = [c for c in reads.columns if c != "table_name"]
    return (reads.select(*rest, F.explode(need).alias("_n"))
            .select(*[c for c in reads.columns if c != "table_name"],
                    F.col("_n.t").alias("table_name"), F.col("_n.p").alias("permission"))
            .select(*reads.columns, "permission"))


def audit_columns(full: DataFrame, visible: DataFrame, table_name: str) -> DataFrame:
    """Every catalog column of a table, whether it is hidden from the
    principal, and how many non-NULL values of it the principal can read
    (0 for a hidden column).

    Catalog columns minus visible columns are the hidden ones (set
    semantics: names compared once, empty names skipped).  The value counts
    are one aggregate pass over the governed view, unpivoted to one row per
    column.
    """
    catalog_cols = [c for c in dict.fromkeys(full.columns) if c]
    seen = set(visible.columns)
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    counts = visible.agg(*[F.count(quoted(c)).alias(c) for c in catalog_cols if c in seen]) \
        if seen else visible.agg(F.count(F.lit(1)).alias("__rows"))
    entries = []
    for c in catalog_cols:
        val = quoted(c) if c in seen else F.lit(0)
        entries.append(F.struct(F.lit(c).alias("column_name"),
                                F.lit(c not in seen).alias("hidden"),
                                val.cast("bigint").alias("values_visible")))
    return counts.select(F.explode(F.array(*entries)).alias("e")).select(
        F.lit(table_name).alias("table_name"), "e.column_name", "e.hidden", "e.values_visible")


def audit_rows(df: DataFrame, policies: dict[str, str]) -> DataFrame:
    """Per principal the visible, total and hidden row counts.

    All principals are audited in one pass: one ``count_if`` per policy in a
    single aggregate, then unpivoted.  A principal without a row filter
    sees every row.
    """
    aggs = [F.count(F.lit(1)).alias("__total")]
    names = list(policies)
    for i, p in enumerate(names):
        pred = F.expr(policies[p]) if policies[p] else F.lit(True)
        aggs.append(F.count_if(F.coalesce(pred, F.lit(False))).alias(f"__v{i}"))
    one = df.agg(*aggs)
    entries = [F.struct(F.lit(p).alias("principal"), F.col(f"__v{i}").alias("visible_rows"))
               for i, p in enumerate(names)]
    return one.select("__total", F.explode(F.array(*entries)).alias("e")).select(
        "e.principal", "e.visible_rows",
        F.col("__total").alias("total_rows"),
        (F.col("__total") - F.col("e.visible_rows")).alias("hidden_rows"))

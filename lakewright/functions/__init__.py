"""Column functions (P2-P6, P9) and the DDL type name."""

from lakewright.functions.columns import (
    ts_literal, processing_time, partition_columns, null_default, row_hash,
    row_fingerprint, minus_days, sql_type,
)

__all__ = ["ts_literal", "processing_time", "partition_columns", "null_default", "row_hash",
           "row_fingerprint", "minus_days", "sql_type"]

"""Sinks (K1-K9) and verified writes."""

from lakewright.sinks.writers import (
    write_table, merge_into_path, create_table, write_verified, save_report, insert_into, WRITE_MODES,
)

__all__ = ["write_table", "merge_into_path", "create_table", "write_verified", "save_report",
           "insert_into", "WRITE_MODES"]

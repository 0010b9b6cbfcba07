"""Table scans (S1-S5) and file sources/inventory."""

from lakewright.sources.tables import (
    read_table, read_table_with_filter, read_incremental, next_mark,
    sample_access, visible_schema,
)
from lakewright.sources.files import (
    read_text, read_json, read_parquet, read_csv, file_inventory, list_objects, listing_summary,
)

__all__ = [
    "read_table", "read_table_with_filter", "read_incremental", "next_mark",
    "sample_access", "visible_schema",
    "read_text", "read_json", "read_parquet", "read_csv", "file_inventory", "list_objects", "listing_summary",
]

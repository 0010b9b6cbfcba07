"""lakewright: governed-lake data jobs written with the public PySpark API.

Every operator is a function ``DataFrame -> DataFrame`` (or a writer that
takes a DataFrame and a path).  Nothing is collected to the driver except
bounded metadata: counts, one report row, or a size probe of at most
``max_rows + 1`` rows before a broadcast.
"""

from lakewright.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]

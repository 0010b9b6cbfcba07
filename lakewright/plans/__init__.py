"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame
built from the given tables; ``oracle`` holds the DuckDB twin of each."""

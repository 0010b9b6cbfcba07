"""Incremental load with a kept high-water mark."""

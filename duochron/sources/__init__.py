"""Data sets: the adapter over event tables, Parquet, NPZ, and their sinks."""

"""Two-time correlation analytics on Spark: long tables of (angle, i, j, c2) cells, cleaned, scored and fitted as DataFrames."""

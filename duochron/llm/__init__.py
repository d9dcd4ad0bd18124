"""Operators for large training-data pipelines, each on Spark DataFrames.

Nothing outside this subpackage imports it. Every operator takes DataFrames and
returns DataFrames; the thin queries over the driver's tables are in
``queries.py``.
"""

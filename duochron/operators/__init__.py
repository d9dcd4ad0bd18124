"""Operators over the long tables, as functions of DataFrames."""

"""Drivers of iterative fits: each step is one distributed aggregation."""

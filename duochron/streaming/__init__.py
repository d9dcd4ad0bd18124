"""Frames as a stream (an extension): per-angle statistics with watermarks."""

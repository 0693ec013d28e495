"""Readers of raw rows, format detection, and the projections of rows to samples."""

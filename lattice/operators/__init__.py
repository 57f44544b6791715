"""Operators over vectors (idx, v), matrices (i, j, v), byte values, and device catalogs."""

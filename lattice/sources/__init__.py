"""Readers and writers."""

from lattice.sources.tables import read_table

__all__ = ["read_table"]

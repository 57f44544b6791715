"""lattice: index-space array work, device catalogs and task graphs as Spark DataFrames."""

__version__ = "0.1.0"

"""loomlog: an append-only key/value change log and its state algebra on Spark DataFrames."""

__version__ = "1.1.0"

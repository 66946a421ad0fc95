"""Audit large collections of source and text files held in tables, with Spark DataFrames."""

__version__ = "0.1.0"

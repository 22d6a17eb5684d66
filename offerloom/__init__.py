"""Offering records and document facts as Spark DataFrames."""

__version__ = "0.1.0"

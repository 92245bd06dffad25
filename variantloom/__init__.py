"""Curation of controlled text variants on Spark DataFrames."""

__version__ = "0.1.0"

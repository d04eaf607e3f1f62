"""Reconciling versioned snapshots of keyed tables, and preparing text corpora, on Spark DataFrames."""

__version__ = "0.1.0"

"""Operators of a training-data pipeline: filtering, deduplication, mixing, packing and formatting.

Nothing else in the library imports this subpackage.
"""

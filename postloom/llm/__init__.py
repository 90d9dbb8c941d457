"""Operators for training data at scale: deduplication, filtering, language, tokens and packing.

Nothing else in the library imports this subpackage. Every operator takes DataFrames and returns
DataFrames; the queries registered for them are in `queries.py`.
"""

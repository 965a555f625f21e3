"""Batch retrieval and document analytics on Spark DataFrames.

A ranked list is a DataFrame ``(query_id, chunk_id, score, rank)``; every
operator takes and returns DataFrames and works on many queries at once.
"""

__version__ = "0.1.0"

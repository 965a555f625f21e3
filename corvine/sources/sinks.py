"""Logs and events as appended JSON lines, and checks of what comes in."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits of what is accepted.
MOST_QUERY, MOST_K, CHUNK_SIZES, MOST_NAME = 10_000, 50, (10, 10_000), 100
COLLECTION = r"^[A-Za-z0-9_-]{1,100}$"


def append_log(df: DataFrame, path: str) -> None:
    """Add rows to a log of JSON lines."""
    df.write.mode("append").json(path)


def append_events(df: DataFrame, path: str) -> None:
    """Add rows to a table of events; lists, maps and structs become JSON text."""
    nested = [n for n, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    df.withColumns({n: F.to_json(n) for n in nested}).write.mode("append").parquet(path)


def check_queries(queries: DataFrame) -> DataFrame:
    """``queries(query_id, text, k, collection_id)`` with an ``error`` column, null
    where all is well: the first thing that is wrong."""
    text, k = F.col("text"), F.col("k")
    error = (
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty query")
        .when(F.length(text) > MOST_QUERY, "query too long")
        .when(k.isNull() | (k < 1) | (k > MOST_K), "k out of range")
        .when(~F.coalesce(F.col("collection_id").rlike(COLLECTION), F.lit(False)), "bad collection id")
    )
    return queries.withColumn("error", error)


def check_chunking(size: int, overlap: int) -> None:
    """Raises on sizes that can't be."""
    if not CHUNK_SIZES[0] <= size <= CHUNK_SIZES[1]:
        raise ValueError(f"chunk size must be between {CHUNK_SIZES[0]} and {CHUNK_SIZES[1]}")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk")


def safe_name(path: str) -> str:
    """The last part of a path without signs that file systems dislike, at most
    255 characters; raises where nothing is left."""
    name = re.sub(r"[\x00-\x1f<>:\"|?*]", "_", re.split(r"[/\\]", path)[-1]).strip(". ")
    if not name:
        raise ValueError("no file name")
    stem, dot, end = name.rpartition(".")
    return name if len(name) <= 255 else (stem[: 255 - len(dot + end)] + dot + end if stem else name[:255])

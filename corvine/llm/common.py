"""What the operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.storage import bounded, discard, materialize, read_table, shared_dir, spread

__all__ = ["WORD", "bounded", "cut_batches", "discard", "documents", "materialize", "read_table", "records", "shared_dir", "spread", "to_arrow"]

WORD = re.compile(r"\w+")


def documents(spark: SparkSession, base: str, *extra: str) -> DataFrame:
    """``(src, rec_id, text, *extra)`` of the documents table."""
    d = read_table(spark, base, "documents")
    return spread(d.select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("rec_id"), "text", *extra))


def chunks(spark: SparkSession, base: str, *extra: str) -> DataFrame:
    """``(src, rec_id, text, *extra)`` of the chunks table; rows stored twice stay twice."""
    c = read_table(spark, base, "chunks")
    return spread(c.select(F.lit("chunks").alias("src"), F.col("chunk_id").alias("rec_id"), F.col("content").alias("text"), *extra))


def records(spark: SparkSession, base: str) -> DataFrame:
    """Documents and chunks as ``(src, rec_id, text)``."""
    return documents(spark, base).unionByName(chunks(spark, base))


def cut_batches(batches: Iterator[pa.RecordBatch], column: str, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding about ``chars`` bytes of ``column`` each (one
    row at least), so that what a task keeps in memory doesn't follow the row count."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64)
        group = np.cumsum(sizes) // chars
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def to_arrow(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)

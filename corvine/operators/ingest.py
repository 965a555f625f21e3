"""Incremental ingest: what a new version of a file changes, and table writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chunk_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, hash, state)``: unchanged, added or removed. A file without old
    hashes has all its chunks added and none removed; a hash counts once a file."""
    a = old.select(*keys, "hash").filter("hash is not null").distinct().withColumn("o", F.lit(1))
    b = new.select(*keys, "hash").filter("hash is not null").distinct().withColumn("n", F.lit(1))
    j = a.join(b, [*keys, "hash"], "full_outer")
    return j.select(*keys, "hash", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("unchanged").alias("state"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first by ``order``."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with changed rows in place of old ones of the same key."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest(both, keys, [F.desc("_new")]).drop("_new")


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The table without rows of the given keys; absent keys change nothing."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def sweep_orphans(jobs: DataFrame) -> DataFrame:
    """Jobs queued or running at a restart have failed."""
    open_ = F.col("status").isin("queued", "running")
    return jobs.withColumn("error", F.when(open_, F.lit("interrupted by restart")).otherwise(F.col("error"))).withColumn("status", F.when(open_, F.lit("failed")).otherwise(F.col("status")))


def collection_stats(chunks: DataFrame) -> DataFrame:
    """Files and chunks of each collection, counted anew."""
    return chunks.groupBy("collection_id").agg(F.count_distinct("filename").alias("file_count"), F.count_distinct("chunk_id").alias("chunk_count"))


def exact_duplicates(df: DataFrame, text: str) -> DataFrame:
    """Hashes of texts that stand in several rows, with their number."""
    return df.filter(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("hash")).agg(F.count("*").alias("copies")).filter("copies > 1")


# Progress of a job at each stage.
STAGES = {"started": 0.05, "parsed": 0.2, "chunked": 0.4, "encoded": 0.8, "stored": 1.0}


def advance(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs ``(job_id, status, progress, error)`` after ``events(job_id, stage,
    error, at)``: the last event counts; an error fails the job, ``stored``
    completes it, anything else runs. Finished jobs stay as they are, and events
    of unknown jobs make new ones."""
    last = latest(events, ["job_id"], [F.desc("at"), F.desc("stage")])
    table = F.create_map(*[F.lit(x) for p in STAGES.items() for x in p])
    e = last.select("job_id", F.when(F.col("error").isNotNull(), "failed").when(F.col("stage") == "stored", "completed").otherwise("running").alias("s"), F.try_element_at(table, "stage").alias("p"), F.col("error").alias("e"))
    j = jobs.select("job_id", "status", "progress", "error").join(e, "job_id", "full")
    over = F.col("s").isNull() | F.coalesce(F.col("status").isin("completed", "failed"), F.lit(False))
    return j.select("job_id", F.when(over, F.col("status")).otherwise(F.col("s")).alias("status"), F.when(over, F.col("progress")).otherwise(F.coalesce("p", "progress", F.lit(0.0))).alias("progress"), F.when(over, F.col("error")).otherwise(F.col("e")).alias("error"))


def ingest_plan(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, chunk_id, hash, action)`` for ``new(*keys, chunk_index, content)``
    against ``old(*keys, hash)``: ``embed`` for a chunk whose content the file
    didn't have, ``keep`` for one it had, ``remove`` for old hashes that are gone.

    A chunk's id comes of its file, its content and how often that content stood
    before it, so ids don't move when text is put in front. The rows that are no
    ``remove`` are the file's final ids and hashes.
    """
    h = new.select(*keys, "chunk_index", F.sha2("content", 256).alias("hash")).filter("hash is not null")
    nth = F.row_number().over(W.partitionBy(*keys, "hash").orderBy("chunk_index"))
    named = h.withColumn("nth", nth).select(*keys, F.substring(F.sha2(F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys], "hash", F.col("nth").cast("string")), 256), 1, 32).alias("chunk_id"), "hash")
    diff = chunk_diff(old, h, keys)
    kept = named.join(diff.filter("state <> 'removed'"), [*keys, "hash"]).select(*keys, "chunk_id", "hash", F.when(F.col("state") == "added", "embed").otherwise("keep").alias("action"))
    return kept.unionByName(diff.filter("state = 'removed'").select(*keys, F.lit(None).cast("string").alias("chunk_id"), "hash", F.lit("remove").alias("action")))

"""Structured Streaming forms: event windows and continuous ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators.chunking import chunk_documents
from corvine.storage import bounded, discard, materialize

#: Folders of the registry of a batch, by file name.
REGISTRY_PARTS = 16


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events and their sum of values a window and type. On a stream ``late`` is
    how long to wait for late rows; a batch needs none."""
    e = events.withWatermark("ts", late) if late else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str | None = None) -> DataFrame:
    """Sessions of each user: runs of events less than ``gap`` apart."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unique_events(events: DataFrame, key: str, late: str) -> DataFrame:
    """A stream without rows repeated within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def ingest_stream(spark: SparkSession, source: str, sink: str, checkpoint: str):
    """Chunk new documents of a folder of Parquet files as they come.

    Each batch drops files whose hash is known, chunks the rest and appends
    chunks and hashes; a batch that is run again writes its own folder again, so
    rows come out once.
    """
    schema = "filename string, text string"

    def batch(df: DataFrame, n: int) -> None:
        s = df.sparkSession
        bucket = F.pmod(F.xxhash64("filename"), F.lit(REGISTRY_PARTS)).cast("int")
        fresh = materialize(df.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["filename", "hash"]).withColumn("part", bucket), "fresh")
        done = fresh
        parts = [r[0] for r in fresh.select("part").distinct().collect()]  # at most REGISTRY_PARTS numbers
        try:
            # Only the registry's folders of these files are read, and it is not shuffled.
            known = s.read.parquet(f"{sink}/registry").filter((F.col("batch") < n) & F.col("part").isin(parts)).select("filename", "hash")
            fresh = fresh.join(known.join(bounded(fresh.select("filename", "hash")), ["filename", "hash"], "left_semi"), ["filename", "hash"], "left_anti")
        except Exception as e:  # no registry yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        chunk_documents(fresh).write.mode("overwrite").parquet(f"{sink}/chunks/batch={n}")
        fresh.select("filename", "hash", "part").write.mode("overwrite").partitionBy("part").parquet(f"{sink}/registry/batch={n}")
        discard(done)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

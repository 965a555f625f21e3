"""Analytics over query logs and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def frequent(df: DataFrame, key: str, extra: str, most: int) -> DataFrame:
    """The most frequent keys with the least of their other values."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(extra).alias(extra)).orderBy(F.desc("n"), key).limit(most)


def averages(df: DataFrame, by: str, value: str) -> DataFrame:
    """Counts and means of each group; ``mean_positive`` leaves zeros out, as
    latencies of 0 were not measured."""
    v = F.col(value)
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.avg(F.when(v > 0, v)).alias("mean_positive"), F.count_if(v > 0).alias("n_positive"))


def recent(df: DataFrame, by: str, order: str, tie: str, most: int) -> DataFrame:
    """The last rows of each group."""
    return df.withColumn("back", F.row_number().over(W.partitionBy(by).orderBy(F.desc(order), F.desc(tie)))).filter(F.col("back") <= most)


def alive(cache: DataFrame, now: str, ttl_seconds: float) -> DataFrame:
    """Entries whose ``ts`` is not older than their life; 0 or less never ends."""
    if ttl_seconds <= 0:
        return cache
    return cache.filter(F.col("ts") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(ttl_seconds)).cast("decimal(18,6)")))


def newest(cache: DataFrame, most: int) -> DataFrame:
    """The entries that stay when the oldest leave first."""
    return cache.orderBy(F.desc("ts"), F.desc("cache_id")).limit(most)


def exact_cache(queries: DataFrame, cache: DataFrame, now: str, ttl_seconds: float = 3600) -> DataFrame:
    """Queries answered by a living entry of the same key."""
    return queries.join(alive(cache, now, ttl_seconds), "cache_key", "left_semi")


def semantic_cache(queries: DataFrame, cache: DataFrame, now: str, least: float = 0.95, ttl_seconds: float = 3600, most: int = 100) -> DataFrame:
    """``(query_id, cache_id, cosine)``: the entry nearest to each query among the
    ``most`` newest living ones of the same ``k`` and filter, if near enough.

    Takes ``queries(query_id, embedding, k, filter)`` and ``cache(cache_id,
    embedding, k, filter, ts)``; null filters are equal. The cache is bounded by
    ``most`` and broadcast. Ties go by the smaller cache_id.
    """
    from corvine.functions.columns import cosine

    c = F.broadcast(alive(newest(cache, most), now, ttl_seconds).select("cache_id", F.col("embedding").alias("e"), F.col("k").alias("_k"), F.col("filter").alias("_f")))
    near = queries.join(c, (F.col("k") == F.col("_k")) & F.col("filter").eqNullSafe(F.col("_f"))).select("query_id", "cache_id", cosine(F.col("embedding"), F.col("e")).alias("cosine"))
    best = near.groupBy("query_id").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "cache_id")).alias("x")).select("query_id", F.col("x.cache_id").alias("cache_id"), (-F.col("x.c")).alias("cosine"))
    return best.filter(F.col("cosine") >= least)


def low_confidence(queries: DataFrame, retrievals: DataFrame, limit: float, most: int) -> DataFrame:
    """Query events joined with their retrieval events by ``query_hash`` where the
    confidence is below ``limit``, the least sure first. The hash isn't unique on
    either side, so a query that was asked twice comes out with each."""
    low = retrievals.filter(F.col("confidence") < limit)
    return queries.join(low, "query_hash").orderBy("confidence", "query_hash", "query_id", "retrieval_id").limit(most)


def totals(*tables: DataFrame) -> DataFrame:
    """One row with the number of rows of all tables together."""
    from functools import reduce

    counts = [t.agg(F.count("*").alias("n")) for t in tables]
    return reduce(DataFrame.unionByName, counts).agg(F.sum("n").alias("total"))


def cache_key(query, k, collection):
    return F.substring(F.sha2(F.concat_ws(":", query, k.cast("string"), collection), 256), 1, 16)

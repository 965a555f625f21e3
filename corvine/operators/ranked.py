"""Algebra of ranked lists ``(query_id, chunk_id, score, rank)``.

Ranks are 1, 2, ... by falling score, ties by ``chunk_id``. A query with no row
stays without one; null scores rank last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60


def by_score(*keys: str) -> W:
    return W.partitionBy(*(keys or ("query_id",))).orderBy(F.col("score").desc_nulls_last(), F.col("chunk_id"))


def ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(by_score()))


def top_k(df: DataFrame, k: int) -> DataFrame:
    """The k best of each query; Spark keeps only k a task before the shuffle."""
    return ranked(df).filter(F.col("rank") <= k)


def min_max(df: DataFrame) -> DataFrame:
    """Scores of each list stretched to 0..1; all 1 where they are equal."""
    w = W.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return df.withColumn("score", F.when(high - low < 1e-12, 1.0).otherwise((F.col("score") - low) / (high - low)))


def z_score(df: DataFrame) -> DataFrame:
    """Scores of each list by population deviation, then through a sigmoid."""
    w = W.partitionBy("query_id")
    mean, sd = F.avg("score").over(w), F.stddev_pop("score").over(w)
    return df.withColumn("score", F.when(sd < 1e-12, 1.0).otherwise(1 / (1 + F.exp(-(F.col("score") - mean) / sd))))


def max_scaled(df: DataFrame) -> DataFrame:
    """Scores divided by the list's best, if that is above 0."""
    best = F.max("score").over(W.partitionBy("query_id"))
    return df.withColumn("score", F.when(best > 0, F.col("score") / best).otherwise(F.col("score")))


def floor_by(df: DataFrame, least: float) -> DataFrame:
    """Rows of at least ``least``; 0 or less keeps all."""
    return df if least <= 0 else df.filter(F.col("score") >= least)


def _merged(lists: list[DataFrame], how) -> DataFrame:
    together = reduce(DataFrame.unionByName, [x.select("query_id", "chunk_id", "score", "rank") for x in lists])
    return together.groupBy("query_id", "chunk_id").agg(how.alias("score"))


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    return ranked(_merged(lists, F.sum(1.0 / (k + F.col("rank")))))


def max_merge(lists: list[DataFrame], k: int | None = None) -> DataFrame:
    """Union of lists keeping each chunk's best score."""
    out = ranked(_merged(lists, F.max("score")))
    return out if k is None else out.filter(F.col("rank") <= k)


def weighted_fusion(vector: DataFrame, lexical: DataFrame, alpha: Column | float, normalise=min_max) -> DataFrame:
    """``alpha`` of the vector score and the rest of the lexical one, each
    normalised within its list; a chunk missing from one counts 0 there."""
    a = normalise(vector).select("query_id", "chunk_id", F.col("score").alias("v"))
    b = normalise(lexical).select("query_id", "chunk_id", F.col("score").alias("l"))
    w = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer")
    return ranked(both.select("query_id", "chunk_id", (w * F.coalesce("v", F.lit(0.0)) + (1 - w) * F.coalesce("l", F.lit(0.0))).alias("score")))


def corrective_merge(initial: DataFrame, retry: DataFrame, graded: DataFrame, k: int) -> DataFrame:
    """Lists graded low or very low, merged with one retry and cut to ``k``;
    others stay as they are. A query with an empty retry keeps its list, one
    with an empty first list takes the retry's."""
    weak = graded.filter(F.col("level").isin("low", "very_low")).select("query_id").distinct()
    again = max_merge([initial.join(weak, "query_id", "left_semi"), retry.join(weak, "query_id", "left_semi")], k)
    return initial.join(weak, "query_id", "left_anti").select("query_id", "chunk_id", "score", "rank").unionByName(again.select("query_id", "chunk_id", "score", "rank"))


def contrastive(
    positive: DataFrame, negative: DataFrame, vectors: DataFrame, k: int, penalty: float = 0.5, limit: float = 0.7, texts: DataFrame | None = None, terms: DataFrame | None = None
) -> DataFrame:
    """Lower chunks close to what the query excludes: ``penalty`` of the greatest
    cosine to a negative chunk is taken off where it passes ``limit``, and a
    tenth, 0.3 at most, for every occurrence of an excluded term in the chunk's
    text. Rows that fall to 0 or below are dropped. Chunks without a vector keep
    their score. Takes ``texts(chunk_id, text)`` and ``terms(query_id, terms
    ARRAY)`` for the second part."""
    from corvine.functions.columns import cosine, occurrences

    e = vectors.select("chunk_id", "embedding")
    p = positive.select("query_id", "chunk_id", "score").join(e.withColumnRenamed("embedding", "p"), "chunk_id", "left")
    n = negative.select("query_id", "chunk_id").join(e, "chunk_id").select("query_id", F.col("embedding").alias("n"))
    near = p.join(n, "query_id").groupBy("query_id", "chunk_id").agg(F.max(cosine(F.col("p"), F.col("n"))).alias("near"))
    x = p.join(near, ["query_id", "chunk_id"], "left")
    off = F.when(F.col("near") > limit, penalty * F.col("near")).otherwise(0.0)
    if texts is not None and terms is not None:
        x = x.join(texts.select("chunk_id", F.lower("text").alias("_text")), "chunk_id", "left").join(terms.select("query_id", F.col("terms").alias("_terms")), "query_id", "left")
        count = F.coalesce(F.aggregate("_terms", F.lit(0), lambda s, t: s + F.coalesce(occurrences(F.col("_text"), F.lower(t)), F.lit(0))), F.lit(0))
        off = off + F.least(F.lit(0.3), count * 0.1)
    x = x.withColumn("score", F.col("score") - off)
    return top_k(x.filter("score > 0").select("query_id", "chunk_id", "score"), k)

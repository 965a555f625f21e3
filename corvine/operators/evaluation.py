"""Quality of ranked lists against known relevant chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def judged(run: DataFrame, relevant: DataFrame) -> DataFrame:
    """The run's rows with ``rel`` 0 or 1; judgements count once."""
    r = relevant.select("query_id", "chunk_id").distinct().withColumn("hit", F.lit(1))
    return run.select("query_id", "chunk_id", "rank").join(r, ["query_id", "chunk_id"], "left").withColumn("rel", F.coalesce("hit", F.lit(0))).drop("hit")


def metrics(run: DataFrame, relevant: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """``(query_id, rr, ap, p@k, r@k, ndcg@k)`` of every query of ``queries``.

    Precision divides by k, recall and average precision by the number of
    relevant chunks; gain is 1 over log2(rank + 1). A query without a hit, or
    without anything relevant, has 0 throughout.
    """
    j = judged(run, relevant).withColumn("so_far", F.sum("rel").over(W.partitionBy("query_id").orderBy("rank")))
    gain = F.col("rel") / F.log2(F.col("rank") + 1.0)
    parts = [F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rel") == 1, F.col("so_far") / F.col("rank"))).alias("ap_sum")]
    for k in ks:
        near = F.col("rank") <= k
        parts += [F.sum(F.when(near, F.col("rel"))).alias(f"hits_{k}"), F.sum(F.when(near, gain)).alias(f"dcg_{k}")]
    g = j.groupBy("query_id").agg(*parts)
    n = relevant.select("query_id", "chunk_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_rel"))
    x = queries.select("query_id").distinct().join(g, "query_id", "left").join(n, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    cols = [zero(1.0 / F.col("first")).alias("rr"), zero(F.col("ap_sum") / F.col("n_rel")).alias("ap")]
    for k in ks:
        cols += [zero(F.col(f"hits_{k}") / F.lit(float(k))).alias(f"p_{k}"), zero(F.col(f"hits_{k}") / F.col("n_rel")).alias(f"r_{k}"), zero(F.when(F.col("n_rel") > 0, F.col(f"dcg_{k}") / ideal(k))).alias(f"ndcg_{k}")]
    return x.select("query_id", *cols)


def compare(runs: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Mean quality of each strategy of ``runs(strategy, query_id, chunk_id, rank)``."""
    q = runs.select("strategy").distinct().crossJoin(queries.select("query_id").distinct())  # strategies are a handful of settings
    tag = F.concat_ws("\u0001", "strategy", F.col("query_id").cast("string"))
    m = metrics(
        runs.select(tag.alias("query_id"), "chunk_id", "rank"),
        relevant.join(runs.select("strategy").distinct()).select(tag.alias("query_id"), "chunk_id"),
        q.select(tag.alias("query_id")),
        (k,),
    )
    return m.groupBy(F.split("query_id", "\u0001")[0].alias("strategy")).agg(F.avg("rr").alias("mrr"), F.avg("ap").alias("map"), F.avg(f"ndcg_{k}").alias(f"ndcg_{k}"))


def judge(samples: DataFrame, judges: dict[str, object]) -> DataFrame:
    """``samples`` with a column for each judge, a callable that makes a column of
    scores out of columns ``query, answer, context``; scores are held between 0
    and 1, and what isn't a number counts 0.5."""
    raw = {n: f(F.col("query"), F.col("answer"), F.col("context")).cast("double") for n, f in judges.items()}
    return samples.withColumns({n: F.when(c.isNull() | F.isnan(c), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))) for n, c in raw.items()})


def questions(chunks: DataFrame, write, per_chunk: int = 1) -> DataFrame:
    """``(query_id, query, chunk_id)``: synthetic questions whose answer is a chunk.
    ``write(text)`` makes a column of questions, an array of strings."""
    q = chunks.select("chunk_id", F.posexplode(F.slice(write(F.col("text")), 1, per_chunk)).alias("n", "query"))
    return q.filter("query <> ''").select(F.concat_ws("#", F.col("chunk_id").cast("string"), F.col("n").cast("string")).alias("query_id"), "query", "chunk_id")


def export(metrics: DataFrame, path: str, kind: str = "json") -> None:
    """One row of metrics as JSON, or as rows ``metric,value`` of CSV."""
    if kind == "json":
        metrics.coalesce(1).write.mode("overwrite").json(path)
    elif kind == "csv":
        names = metrics.columns
        pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("string").alias("value")) for n in names])
        metrics.select(F.explode(pairs).alias("p")).select("p.*").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"neither json nor csv: {kind}")

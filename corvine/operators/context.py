"""From a ranked list to the context of an answer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.functions.columns import token_count, whitespace_tokens
from corvine.operators.ranked import by_score

def _unit(e: pd.Series) -> np.ndarray:
    x = np.asarray(e.tolist(), dtype=np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def remove_near_duplicates(df: DataFrame, limit: float = 0.95) -> DataFrame:
    """Drop, in rank order, what is too like a row already kept: by cosine above
    ``limit`` where both have a vector, else by the share of common words. Takes
    ``(query_id, chunk_id, score, rank, embedding)`` and, for rows without a
    vector, ``text``; a row with neither stays. Each query's list is one group, as
    long as the list that is given in."""
    kinds = dict(df.dtypes)
    text = F.col("text") if "text" in kinds else F.lit(None).cast("string")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        vectors, bags = None, []
        n, keep = 0, []
        for e, t in zip(g["embedding"], g["text"]):
            bag = frozenset((t or "").lower().split())
            if e is not None:
                u = _unit(pd.Series([e]))[0]
                ok = n == 0 or float((vectors[:n] @ u).max()) <= limit
                if ok:
                    if vectors is None or n == len(vectors):
                        vectors = np.resize(vectors if vectors is not None else np.zeros((1, len(u))), (max(16, 2 * n), len(u)))
                    vectors[n] = u
                    n += 1
            else:
                ok = not bag or all(len(bag & b) / len(bag | b) <= limit for b in bags)
            keep.append(ok)
            if ok and bag:
                bags.append(bag)
        return g.loc[keep, ["query_id", "chunk_id", "score", "rank"]]

    return df.select("query_id", "chunk_id", "score", "rank", "embedding", text.alias("text")).groupBy("query_id").applyInPandas(one, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double, rank int")


def diversify(df: DataFrame, k: int, weight: float = 0.5, limit: float = 0.5) -> DataFrame:
    """Maximal marginal relevance: next comes the row whose relevance, less its
    likeness to those chosen where that passes ``limit``, is greatest. Relevance
    is the score stretched to 0..1; the new score is ``1 - rank / n`` counted
    from 0. Rows without a vector are left out; ties go by old rank."""
    kinds = dict(df.dtypes)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g[g["embedding"].notna()].sort_values("rank").reset_index(drop=True)
        n = len(g)
        if n == 0:
            return g[["query_id", "chunk_id", "score", "rank"]]
        s = g["score"].to_numpy(dtype=float)
        rel = np.ones(n) if np.ptp(s) < 1e-12 else (s - s.min()) / np.ptp(s)
        u = _unit(g["embedding"])
        near, left, order = np.full(n, -1.0), np.ones(n, dtype=bool), []
        for _ in range(min(k, n)):
            value = weight * rel - (1 - weight) * np.where(near > limit, near, 0.0)
            value[~left] = -np.inf
            i = int(np.argmax(value))
            order.append(i)
            left[i] = False
            near = np.maximum(near, u @ u[i])
        m = len(order)
        return pd.DataFrame({"query_id": g["query_id"].iloc[order].to_numpy(), "chunk_id": g["chunk_id"].iloc[order].to_numpy(), "score": [1 - j / m for j in range(m)], "rank": range(1, m + 1)})

    return df.select("query_id", "chunk_id", "score", "rank", "embedding").groupBy("query_id").applyInPandas(one, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double, rank int")


def within_budget(df: DataFrame, budget: int, least: int = 100) -> DataFrame:
    """Chunks by falling score until the token budget is used. The first that
    doesn't fit is cut to the rest if more than ``least`` tokens are left (at its
    last full stop if that keeps 70 %), and all after it are dropped. Takes
    ``(query_id, chunk_id, score, text)``, gives ``(…, n_tokens, text)``."""
    w = by_score()
    x = df.withColumn("n_tokens", token_count(F.col("text"))).withColumn("run", F.sum("n_tokens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    x = x.withColumn("over", F.col("run") > budget).withColumn("earlier", F.coalesce(F.lag("over").over(w), F.lit(False)))
    x = x.filter(~F.col("over") | ~F.col("earlier"))
    room = budget - (F.col("run") - F.col("n_tokens"))
    cut = F.substring("text", F.lit(1), (room * 4).cast("int"))
    stop = F.length(cut) - F.instr(F.reverse(cut), ".") + 1
    tail = F.when((F.instr(cut, ".") > 0) & (stop >= 0.7 * F.length(cut)), F.substring(cut, F.lit(1), stop.cast("int"))).otherwise(cut)
    x = x.filter(~F.col("over") | (room > least))
    out = x.withColumn("body", F.when(F.col("over"), tail).otherwise(F.col("text"))).withColumn("chunk_id", F.when(F.col("over"), F.concat(F.col("chunk_id").cast("string"), F.lit("_truncated"))).otherwise(F.col("chunk_id").cast("string")))
    return out.select("query_id", "chunk_id", "score", token_count(F.col("body")).alias("n_tokens"), F.col("body").alias("text"))


def inject_pinned(df: DataFrame, pinned: DataFrame, budget: int = 2000) -> DataFrame:
    """Pinned chunks of a query before its own, with score 1, in file and chunk
    order up to ``4 * budget`` characters; own rows of pinned files go. Takes
    ``(query_id, chunk_id, filename, score, rank)`` and ``pinned(query_id,
    chunk_id, filename, file_order, chunk_index, text)``."""
    w = W.partitionBy("query_id").orderBy("file_order", "chunk_index", "chunk_id")
    p = pinned.withColumn("run", F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, 0))).filter(F.col("run") <= 4 * budget)
    p = p.withColumn("place", F.row_number().over(w)).select("query_id", "chunk_id", "filename", F.lit(1.0).alias("score"), F.lit(0).alias("own"), "place")
    files = pinned.select("query_id", "filename").distinct()
    rest = df.join(files, ["query_id", "filename"], "left_anti").select("query_id", "chunk_id", "filename", "score", F.lit(1).alias("own"), F.col("rank").alias("place"))
    return p.unionByName(rest).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("own", "place", "chunk_id"))).select("query_id", "chunk_id", "filename", "score", "rank")


def relevant_sentences(df: DataFrame, most: int = 5) -> DataFrame:
    """The sentences of each chunk sharing most words with the query, in order of
    that number and then of place. Takes ``(query_id, chunk_id, query, text)``."""
    s = df.select("query_id", "chunk_id", F.array_distinct(whitespace_tokens(F.col("query"))).alias("q"), F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("pos", "sentence"))
    s = s.withColumn("overlap", F.size(F.array_intersect("q", whitespace_tokens(F.col("sentence")))))
    w = W.partitionBy("query_id", "chunk_id").orderBy(F.desc("overlap"), "pos")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("query_id", "chunk_id", "pos", "sentence", "overlap", "rank")


def prompt(df: DataFrame) -> DataFrame:
    """Numbered sources of each query as one text. Takes ``(query_id, chunk_id,
    filename, score, rank, text)``; a list is short, so a query's text is too."""
    line = F.format_string("[%d] %s (score: %.1f%%)\n%s", F.col("rank"), F.col("filename"), F.col("score") * 100, F.col("text"))
    return df.groupBy("query_id").agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])).alias("prompt"))


def sources(df: DataFrame, most: int | None = None, length: int = 500) -> DataFrame:
    """``(query_id, rank, chunk_id, filename, score, snippet)``: what is shown of a
    list, texts longer than ``length`` cut with an ellipsis. Takes ``(query_id,
    chunk_id, filename, score, rank, text)``."""
    x = df if most is None else df.filter(F.col("rank") <= most)
    return x.select("query_id", "rank", "chunk_id", "filename", "score", F.when(F.length("text") > length, F.concat(F.substring("text", 1, length), F.lit("…"))).otherwise(F.col("text")).alias("snippet"))


def compress(df: DataFrame, budget: int, shorten, share: float = 0.8) -> DataFrame:
    """A second pass over lists that use more than ``share`` of the budget:
    ``shorten(text)`` makes a column of each text (a Pandas UDF around a model).
    Takes and gives ``(query_id, chunk_id, score, n_tokens, text)``."""
    used = F.sum("n_tokens").over(W.partitionBy("query_id"))
    x = df.withColumn("_used", used)
    text = F.when(F.col("_used") > share * budget, shorten(F.col("text"))).otherwise(F.col("text"))
    return x.select("query_id", "chunk_id", "score", text.alias("text")).select("query_id", "chunk_id", "score", token_count(F.col("text")).alias("n_tokens"), "text")

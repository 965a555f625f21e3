"""Queries in several hops: a plan of sub-queries, and its execution over all
queries at once, level by level."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.operators.ranked import top_k
from corvine.storage import materialize

# Patterns of the three kinds of plans, in the order they are tried, and where a sequence is cut.
SEQUENTIAL = [r"(\w+)(?:'s|s')\s+(\w+).*?(?:and|then).*?(\w+)", r"based on.*?(?:and|then)", r"after.*?(?:and|then)"]
COMPARISON = [r"\bcompare\b.*?\band\b", r"\bdifference between\b.*?\band\b", r"\bversus\b|\bvs\.?\b", r"\bboth\b.*?\band\b"]
AGGREGATION = [r"\ball\b.*?\babout\b", r"\beverything\b.*?\brelated to\b", r"\bsummarize\b", r"\blist all\b"]
CUTS = [r"\s+and then\s+", r"\s+then\s+", r"\s+and\s+"]
SIDES = r"(\w+(?:\s+\w+)*?)\s+(?:and|versus|vs\.?)\s+(\w+(?:\s+\w+)*)"


def _hop(no: int, kind: str, query: Column, *parents: int) -> Column:
    return F.struct(F.lit(no).alias("hop_id"), F.lit(kind).alias("hop_type"), query.alias("query"), F.array(*map(F.lit, parents)).cast("array<int>").alias("parents"))


def decompose(q: Column, max_hops: int = 3) -> Column:
    """Struct of a query's ``reasoning``, its ``hops`` and a ``confidence``.

    A sequence is cut in two at the first place where one step follows another; a
    comparison asks for either side and then for the whole; a collection asks
    broadly and then sums up; any other query is one hop.
    """
    low = F.lower(q)
    any_of = lambda ps: reduce(lambda a, b: a | b, [low.rlike(p) for p in ps])
    cut = lambda p: F.split(q, f"(?i){p}", 2)
    parts = F.coalesce(*[F.when(F.size(cut(p)) > 1, cut(p)) for p in CUTS], F.array(q))
    steps = F.slice(F.transform(parts, lambda x, i: F.struct(i.cast("int").alias("hop_id"), F.when(i > 0, "bridge").otherwise("initial").alias("hop_type"), F.trim(x).alias("query"), F.when(i > 0, F.array((i - 1).cast("int"))).otherwise(F.array().cast("array<int>")).alias("parents"))), 1, max_hops)
    a, b = (F.regexp_extract(q, f"(?i){SIDES}", i) for i in (1, 2))
    aspect = F.regexp_extract(q, r"^\s*(\S+)", 1)
    sides = F.array(_hop(0, "initial", F.concat_ws(" ", aspect, a)), _hop(1, "initial", F.concat_ws(" ", aspect, b)), _hop(2, "comparison", q, 0, 1))
    compared = F.when(a != "", sides).otherwise(F.array(_hop(0, "comparison", q)))
    collected = F.array(_hop(0, "initial", q), _hop(1, "aggregation", q, 0))
    reasoning = F.when(any_of(SEQUENTIAL), "sequential").when(any_of(COMPARISON), "parallel").when(any_of(AGGREGATION), "hierarchical").otherwise("single")
    hops = F.when(any_of(SEQUENTIAL), steps).when(any_of(COMPARISON), compared).when(any_of(AGGREGATION), collected).otherwise(F.array(_hop(0, "initial", q)))
    return F.struct(reasoning.alias("reasoning"), hops.alias("hops"), F.when(F.size(hops) > 1, 0.9).otherwise(0.5).alias("confidence"))


def plan(queries: DataFrame, max_hops: int = 3) -> DataFrame:
    """``(query_id, reasoning, confidence, hop_id, hop_type, query, parents)``, a
    row a hop of ``queries(query_id, text)``; null texts give none."""
    d = queries.filter("text is not null").select("query_id", decompose(F.col("text"), max_hops).alias("d"))
    return d.select("query_id", "d.reasoning", "d.confidence", F.explode("d.hops").alias("h")).select("query_id", "reasoning", "confidence", "h.*")


def execute(hops: DataFrame, search: Callable[[DataFrame, int], DataFrame], k: int, names: DataFrame | None = None, most_hops: int = 5) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: the best of all hops of a query, each
    chunk with its highest score.

    ``search(queries(query_id, text), k)`` gives ranked lists. Hops run level by
    level, all queries at once. ``[name]`` in a hop's query becomes the first of
    the names of its parents' three best chunks that holds it; ``names(chunk_id,
    name)`` has the names of the chunks. Levels from ``most_hops`` on don't run.
    """
    found: list[DataFrame] = []
    known: DataFrame | None = None  # (query_id, hop_id, name) of the levels before
    for level in range(most_hops):
        now = hops.filter(F.col("hop_id") == level).select("query_id", "hop_id", "query", "parents")
        if level and now.isEmpty():
            break
        if known is not None:
            asked = now.select("query_id", "hop_id", "query", F.explode("parents").alias("parent"), F.explode(F.regexp_extract_all("query", F.lit(r"\[(\w+)\]"), 1)).alias("hole"))
            fits = asked.join(known.withColumnsRenamed({"hop_id": "parent"}), ["query_id", "parent"]).filter(F.contains(F.lower("name"), F.lower("hole")))
            filled = fits.groupBy("query_id", "hole").agg(F.min("name").alias("name")).groupBy("query_id").agg(F.collect_list(F.struct("hole", "name")).alias("fill"))
            now = now.join(filled, "query_id", "left").withColumn("query", F.when(F.col("fill").isNull(), F.col("query")).otherwise(F.aggregate("fill", F.col("query"), lambda s, x: F.replace(s, F.concat(F.lit("["), x["hole"], F.lit("]")), x["name"]))))
        lists = materialize(search(now.select("query_id", F.col("query").alias("text")), k).select("query_id", "chunk_id", "score", "rank"), "hop")
        found.append(lists)
        if names is not None:
            mine = lists.filter("rank <= 3").join(names, "chunk_id").select("query_id", F.lit(level).alias("hop_id"), "name").distinct()
            known = mine if known is None else known.unionByName(mine)
    every = reduce(DataFrame.unionByName, found)
    return top_k(every.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k)


def hop_counts(hops: DataFrame) -> DataFrame:
    """``(reasoning, queries, hops)`` of plans."""
    per = hops.withColumn("n", F.count("*").over(W.partitionBy("query_id")))
    return per.groupBy("reasoning").agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("hops"))

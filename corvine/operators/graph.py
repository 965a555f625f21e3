"""Entity graph: vertices are names, edges join names of one chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.storage import materialize

NAME = r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?![A-Za-z0-9_])"
#: Names taken from a chunk, title and section included; more can be asked for, and None takes all.
PER_CHUNK = 10


def entities(chunks: DataFrame, pattern: str = NAME, per_chunk: int | None = PER_CHUNK) -> DataFrame:
    """``(chunk_id, name)``: the first distinct runs of capitalised words of a chunk."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(f"({pattern})"), 1), lambda x: F.regexp_replace(x, r"\s+", " ")))
    return chunks.select("chunk_id", F.explode(found if per_chunk is None else F.slice(found, 1, per_chunk)).alias("name")).distinct()


def typed_entities(chunks: DataFrame, per_chunk: int | None = PER_CHUNK) -> DataFrame:
    """``(chunk_id, name, kind)`` of ``chunks(chunk_id, text, title, section)``:
    title and section as concepts, then runs of two capitalised words or more that
    don't begin a sentence, also at the end of the text. Names that differ in
    case are one, the first found."""
    inner = rf"(?<![.!?]\s)(?<![.!?]\s\s)(?<!^)({NAME})"
    runs = F.transform(F.regexp_extract_all("text", F.lit(inner), 1), lambda x: F.struct(F.regexp_replace(x, r"\s+", " ").alias("name"), F.lit("ENTITY").alias("kind")))
    concept = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.struct(F.trim(c).alias("name"), F.lit("CONCEPT").alias("kind")))
    every = F.filter(F.concat(F.array(concept("title"), concept("section")), F.coalesce(runs, F.array().cast("array<struct<name:string,kind:string>>"))), lambda x: x.isNotNull())
    first = F.filter(every, lambda x, i: F.size(F.filter(F.slice(every, 1, i), lambda y: F.lower(y["name"]) == F.lower(x["name"]))) == 0)
    return chunks.select("chunk_id", F.explode(first if per_chunk is None else F.slice(first, 1, per_chunk)).alias("e")).select("chunk_id", "e.name", "e.kind")


def kept_entities(mentions: DataFrame, least: int = 2) -> DataFrame:
    """Names of at least ``least`` chunks."""
    return mentions.groupBy("name").agg(F.count_distinct("chunk_id").alias("chunks")).filter(F.col("chunks") >= least)


def co_occurrence(mentions: DataFrame) -> DataFrame:
    """``(src, dst, weight)`` in both directions, weight being the number of
    chunks holding both. Pairs are made within a chunk's own list of names, which
    its text bounds, so no name's frequency squares. Give only the mentions of
    ``kept_entities`` where rare names are to be no vertices."""
    lists = mentions.groupBy("chunk_id").agg(F.collect_set("name").alias("names"))
    a = lists.select("names", F.explode("names").alias("src")).select("src", F.explode("names").alias("dst")).filter("src <> dst")
    return a.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def expand(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``(name, hops)`` of all names within ``depth`` edges of the seeds."""
    seen = seeds.select("name").distinct().withColumn("hops", F.lit(0))
    for h in range(1, depth + 1):
        step = seen.filter(F.col("hops") == h - 1).join(edges, F.col("name") == F.col("src")).select(F.col("dst").alias("name")).distinct()
        seen = seen.unionByName(step.join(seen.select("name"), "name", "left_anti").withColumn("hops", F.lit(h)))
    return seen


def page_rank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """``(name, importance)`` after a fixed number of weighted rounds; what has no
    way out gives its share to all. Lineage is cut every few rounds."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    e = materialize(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")), "edges")
    names = materialize(e.select(F.col("src").alias("name")).union(e.select("dst")).distinct(), "names")
    n = names.count()
    if n == 0:
        return names.withColumn("importance", F.lit(0.0))
    rank = names.withColumn("importance", F.lit(1.0 / n))
    ends = e.select(F.col("src").alias("name")).distinct()
    for i in range(1, rounds + 1):
        flow = rank.join(e, F.col("name") == F.col("src")).groupBy(F.col("dst").alias("name")).agg(F.sum(F.col("importance") * F.col("p")).alias("x"))
        lost = rank.join(ends, "name", "left_anti").agg(F.coalesce(F.sum("importance"), F.lit(0.0)).alias("lost"))
        rank = names.join(flow, "name", "left").crossJoin(F.broadcast(lost)).select("name", ((1 - damping) / n + damping * (F.coalesce("x", F.lit(0.0)) + F.col("lost") / n)).alias("importance"))  # one row of loss
        if i % 4 == 0:
            rank = materialize(rank, "rank")
    return rank


def centroids(mentions: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(name, embedding)``: mean of the vectors of a name's chunks, length 1.
    Vectors that are all zero or hold a null, NaN or infinity don't count, and of
    several rows of a chunk the least one does. Sums run per dimension, so a
    frequent name is pre-aggregated everywhere."""
    sound = vectors.filter(F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    one = sound.groupBy("chunk_id").agg(F.min("embedding").alias("embedding"))
    e = mentions.join(one, "chunk_id").select("name", F.posexplode("embedding").alias("d", "x"))
    m = e.groupBy("name", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = m.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("e"))
    size = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    return v.select("name", F.transform("e", lambda x: x / F.when(size > 0, size).otherwise(1.0)).alias("embedding"))


def rescore(ranked: DataFrame, mentions: DataFrame, names: DataFrame, alpha: float = 0.7) -> DataFrame:
    """Chunks already found that mention an expanded name: ``alpha`` of their score
    and the rest from the mean importance of those names. A query without a name
    keeps its list."""
    hit = mentions.join(names, "name").groupBy("query_id", "chunk_id").agg(F.avg("importance").alias("i"))
    own = ranked.join(hit, ["query_id", "chunk_id"]).select("query_id", "chunk_id", (alpha * F.col("score") + (1 - alpha) * F.col("i")).alias("score"))
    rest = ranked.join(names.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "chunk_id", "score")
    return own.unionByName(rest).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def rescore_by_vectors(ranked: DataFrame, query_vectors: DataFrame, chunk_vectors: DataFrame, entity_vectors: DataFrame, mentions: DataFrame, expanded: DataFrame, alpha: float = 0.7) -> DataFrame:
    """Chunks already found that mention an expanded name: ``alpha`` of the dot
    product with the query, the rest from the mean over those names of their own
    dot product times importance. A query without a name keeps its list.

    Takes ``expanded(query_id, name, importance)`` and ``embedding`` columns; a
    missing vector counts 0 and a missing importance 1.
    """
    from corvine.functions.columns import dot

    q = query_vectors.select("query_id", F.col("embedding").alias("q"))
    own = dot(F.col("q"), F.col("e"))
    names = expanded.join(q, "query_id").join(entity_vectors.select("name", F.col("embedding").alias("e")), "name", "left").select("query_id", "name", (F.coalesce(own, F.lit(0.0)) * F.coalesce("importance", F.lit(1.0))).alias("i"))
    rows = ranked.join(q, "query_id").join(chunk_vectors.select("chunk_id", F.col("embedding").alias("e")), "chunk_id", "left").select("query_id", "chunk_id", F.coalesce(own, F.lit(0.0)).alias("v"))
    hit = rows.join(mentions, "chunk_id").join(names, ["query_id", "name"]).groupBy("query_id", "chunk_id").agg((alpha * F.first("v") + (1 - alpha) * F.avg("i")).alias("score"))
    rest = ranked.join(expanded.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "chunk_id", "score")
    return hit.unionByName(rest).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def between(expanded: DataFrame, edges: DataFrame) -> DataFrame:
    """``(query_id, src, dst, weight)``: the edges both names of which a query has,
    each pair once. An edge goes to the queries of the name that fewer have, and
    these are asked for the other one, so a name that many queries have and that
    many edges lead to doesn't multiply the two."""
    held = expanded.groupBy("name").agg(F.count("*").alias("n"))
    e = edges.filter("src < dst").select("src", "dst", "weight")
    e = e.join(held.select(F.col("name").alias("src"), F.col("n").alias("a")), "src").join(held.select(F.col("name").alias("dst"), F.col("n").alias("b")), "dst")
    e = e.select("src", "dst", "weight", F.when(F.expr("a <= b"), F.col("src")).otherwise(F.col("dst")).alias("rare"), F.when(F.expr("a <= b"), F.col("dst")).otherwise(F.col("src")).alias("other"))
    asked = expanded.select("query_id", F.col("name").alias("rare")).join(e, "rare")
    return asked.join(expanded.select("query_id", F.col("name").alias("other")), ["query_id", "other"]).select("query_id", "src", "dst", "weight")


def trace(expanded: DataFrame, edges: DataFrame, most_names: int | None = None, most_edges: int | None = None) -> DataFrame:
    """``(query_id, names, edges, total_names, total_edges)``: what an expansion
    ``(query_id, name, hops)`` went through, its names, the nearest first, and all
    edges between them, the heaviest first, each pair once. For a picture the
    nearest ``most_names`` with the edges between these and of them the heaviest
    ``most_edges`` can be asked for."""
    n = expanded.withColumn("shown", F.lit(True) if most_names is None else F.row_number().over(W.partitionBy("query_id").orderBy("hops", "name")) <= most_names)
    both = between(n.filter("shown"), edges)
    heavy = both.withColumn("shown", F.lit(True) if most_edges is None else F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("weight"), "src", "dst")) <= most_edges)
    lists = heavy.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct((-F.col("weight")).alias("n"), "src", "dst", "weight")))).alias("edges"), F.count("*").alias("total_edges"))
    names = n.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct("hops", "name")))).alias("names"), F.count("*").alias("total_names"))
    return names.join(lists, "query_id", "left").select("query_id", "names", F.transform("edges", lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), e["weight"].alias("weight"))).alias("edges"), "total_names", F.coalesce("total_edges", F.lit(0)).alias("total_edges"))


def neighbours(edges: DataFrame, names: DataFrame, most: int = 10) -> DataFrame:
    """``(name, neighbour, weight, rank)``: the strongest neighbours of some names."""
    w = W.partitionBy("name").orderBy(F.desc("weight"), "neighbour")
    e = edges.join(names.select(F.col("name").alias("src")).distinct(), "src").select(F.col("src").alias("name"), F.col("dst").alias("neighbour"), "weight")
    return e.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def top_names(importance: DataFrame, mentions: DataFrame, most: int = 10) -> DataFrame:
    """The most important names, the more often mentioned first of equals."""
    n = mentions.groupBy("name").agg(F.count_distinct("chunk_id").alias("chunks"))
    return importance.join(n, "name").orderBy(F.desc("importance"), F.desc("chunks"), "name").limit(most)


def statistics(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: names, chunks, mentions and undirected edges of a graph."""
    a = mentions.agg(F.count_distinct("name").alias("names"), F.count_distinct("chunk_id").alias("chunks"), F.count("*").alias("mentions"))
    return a.join(edges.filter("src < dst").agg(F.count("*").alias("edges")))  # one row each


def save(path: str, mentions: DataFrame, edges: DataFrame, importance: DataFrame) -> None:
    """Keep a graph as three tables in a folder."""
    for df, name in ((mentions, "mentions"), (edges, "edges"), (importance, "importance")):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("mentions", "edges", "importance"))


def export(mentions: DataFrame, edges: DataFrame, importance: DataFrame, most_chunks: int = 100) -> tuple[DataFrame, DataFrame]:
    """Vertices ``(id, kind, importance)`` and edges ``(src, dst, kind, weight)``
    for a picture: all names and the first ``most_chunks`` chunks."""
    chunks = mentions.select("chunk_id").distinct().orderBy("chunk_id").limit(most_chunks)
    v = importance.select(F.col("name").alias("id"), F.lit("entity").alias("kind"), "importance").unionByName(chunks.select(F.col("chunk_id").cast("string").alias("id"), F.lit("chunk").alias("kind"), F.lit(None).cast("double").alias("importance")))
    m = mentions.join(chunks, "chunk_id").select(F.col("chunk_id").cast("string").alias("src"), F.col("name").alias("dst"), F.lit("mentions").alias("kind"), F.lit(1).cast("bigint").alias("weight"))
    return v, m.unionByName(edges.select("src", "dst", F.lit("co_occurs").alias("kind"), "weight"))

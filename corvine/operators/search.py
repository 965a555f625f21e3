"""Retrieval: exact vector search in blocks and BM25.

Both send the queries to the data: what is broadcast is one block of queries,
never larger than ``BLOCK_BYTES``, and each task sends back its k best of every
query. More queries than fit go in further blocks, each a scan of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.functions.columns import whitespace_tokens
from corvine.operators.ranked import top_k
from corvine.storage import bounded, materialize, spread

#: Bytes of query vectors or weighted query terms that go to every task at once.
BLOCK_BYTES = 48 << 20
#: Scores a task works out at a time.
STEP = 1 << 22


class Best:
    """The k best rows of each query so far, with all that tie with the last."""

    def __init__(self, queries: int, k: int, keys: pa.DataType):
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.query, self.score = np.zeros(0, np.int64), np.zeros(0)
        self.keys = pa.array([], keys)
        self.added = 0

    def add(self, query: np.ndarray, score: np.ndarray, keys: pa.Array) -> None:
        good = score >= self.floor[query]
        if not good.any():
            return
        self.query, self.score = np.concatenate([self.query, query[good]]), np.concatenate([self.score, score[good]])
        self.keys = pa.concat_arrays([self.keys, keys.filter(pa.array(good))])
        self.added += int(good.sum())
        if self.added > 4 * self.k * len(self.floor) + 50_000:
            self.compact()

    def compact(self) -> None:
        order = np.lexsort((-self.score, self.query))
        q, s = self.query[order], self.score[order]
        first = np.searchsorted(q, q, side="left")
        last = np.minimum(first + self.k, np.searchsorted(q, q, side="right")) - 1
        keep = s >= s[last]
        full = np.arange(len(q)) - first == self.k - 1
        self.floor[q[full]] = s[full]
        self.query, self.score, self.keys = q[keep], s[keep], self.keys.take(pa.array(order[keep]))
        self.added = 0

    def rows(self, ids: pa.Array) -> pa.RecordBatch:
        self.compact()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(self.query)), self.keys, pa.array(self.score)], names=["query_id", "chunk_id", "score"])


def _blocks(queries: DataFrame, bytes_each: int) -> list[DataFrame]:
    """Queries in parts of at most about ``BLOCK_BYTES``, by a hash of their id."""
    n = queries.count()
    parts = max(1, -(-n * bytes_each // BLOCK_BYTES))
    return [queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]


def _in_blocks(corpus: DataFrame, blocks: list[DataFrame], load: Callable, scan: Callable, schema: str, k: int, exclude_self: bool) -> DataFrame:
    """The lists of all queries; the driver holds one block at a time."""
    sc = corpus.sparkSession.sparkContext
    done = []
    for block in blocks:
        shared = sc.broadcast(load(block))
        found = corpus.mapInArrow(lambda batches, shared=shared: scan(batches, shared.value), schema)
        best = top_k(found.filter("query_id <> chunk_id") if exclude_self else found, k)
        if len(blocks) > 1:
            best = materialize(best, "block")
            shared.destroy()
        done.append(best)
    return reduce(DataFrame.unionByName, done)


def vector_top_k(corpus: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """The k nearest of ``corpus(key, embedding)`` for each of
    ``queries(query_id, embedding)``, as ``(query_id, chunk_id, score, rank)``.

    Metric ``cosine`` scores by cosine, ``l2`` by ``1 / (1 + d)``. The first
    query's length is the dimension. Null vectors, vectors of another length and,
    for cosine, all-zero ones are left out. Ties go by key. No query or no vector
    gives no row. Further columns are ignored.
    """
    spark = corpus.sparkSession
    kinds = dict(corpus.dtypes)[key], dict(queries.dtypes)["query_id"]
    schema = f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double"
    q = materialize(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding is not null and size(embedding) > 0"), "queries")
    first = q.select(F.size("embedding")).first()
    if first is None:
        return top_k(spark.createDataFrame([], schema), k)
    dim = first[0]
    sound = lambda c: (F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull())
    c = corpus.select(F.col(key).alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(sound("embedding"))
    take = k + exclude_self

    def load(block: DataFrame) -> tuple[pa.Array, np.ndarray]:
        t = block.filter(sound("embedding")).toArrow()
        ids = t.column("query_id").combine_chunks()
        return ids, np.asarray(t.column("embedding").combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim)

    def scan(batches: Iterator[pa.RecordBatch], held: tuple) -> Iterator[pa.RecordBatch]:
        ids, q = held
        square = (q * q).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = q / np.sqrt(square)[:, None]
        best = None
        for b in batches:
            x = np.asarray(b.column("embedding").flatten(), dtype=np.float64).reshape(-1, dim)
            keys = b.column("chunk_id")
            best = best or Best(len(q), take, keys.type)
            if metric == "cosine":
                with np.errstate(divide="ignore", invalid="ignore"):
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
            else:
                mine = (x * x).sum(axis=1)
            width = max(1, STEP // max(1, len(x)))
            for a in range(0, len(q), width) if len(x) else ():
                part = slice(a, a + width)
                s = unit[part] @ x.T if metric == "cosine" else 1 / (1 + np.sqrt(np.maximum(0, square[part, None] + mine[None, :] - 2 * q[part] @ x.T)))
                s[~np.isfinite(s)] = -np.inf
                if s.shape[1] > take:  # ties at the edge stay for the final order
                    edge = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take]
                    qi, xi = np.nonzero((s >= np.maximum(edge, best.floor[part])[:, None]) & np.isfinite(s))
                else:
                    qi, xi = np.nonzero(np.isfinite(s))
                best.add(qi + a, s[qi, xi], keys.take(pa.array(xi)))
        if best is not None:
            yield best.rows(ids)

    return _in_blocks(c, _blocks(q, 8 * dim + 16), load, scan, schema, k, exclude_self)


def bm25(corpus: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, keep_zero: bool = False, tokens: Callable = whitespace_tokens) -> DataFrame:
    """Okapi scores of ``corpus(chunk_id, text)`` for ``queries(query_id, text)``.

    Tokens are split at white space and lower-cased, or what ``tokens`` makes of
    a text column. A term in more than half of all chunks gets a quarter of the
    vocabulary's mean idf. Query terms count as often as they stand in the query.
    A chunk without any query term has no row; with ``keep_zero`` a list shorter
    than ``k`` goes on with such chunks, by id, at score 0. Null texts have no
    term. Ties go by id. Document frequencies are the only shuffle that grows
    with the corpus, one row a term and task; scoring is done where the chunks
    are read.
    """
    spark = corpus.sparkSession
    kinds = dict(corpus.dtypes)["chunk_id"], dict(queries.dtypes)["query_id"]
    schema = f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double"
    t = spread(corpus.select("chunk_id", "text")).select("chunk_id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("t"))
    q = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    n, mean = t.agg(F.count("*"), F.coalesce(F.avg(F.size("t")), F.lit(0.0))).first()
    df = materialize(t.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    idf0 = df.select("term", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    low = 0.25 * (idf0.agg(F.avg("idf")).first()[0] or 0.0)
    idf = idf0.select("term", F.when(F.col("idf") < 0, low).otherwise(F.col("idf")).alias("idf"))
    q = materialize(idf.join(bounded(q), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")), "weights")

    def load(block: DataFrame) -> tuple:
        x = block.toArrow()
        ids, terms = (x.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "term"))
        order = np.argsort(np.asarray(terms.indices), kind="stable")
        starts = np.searchsorted(np.asarray(terms.indices)[order], np.arange(len(terms.dictionary) + 1))
        return ids.dictionary, terms.dictionary, starts, np.asarray(ids.indices, dtype=np.int64)[order], np.asarray(x.column("weight"))[order]

    def scan(batches: Iterator[pa.RecordBatch], held: tuple) -> Iterator[pa.RecordBatch]:
        ids, terms, starts, owner, weight = held
        best = None
        for batch in batches:
            keys, lists = batch.column("chunk_id"), batch.column("t")
            best = best or Best(len(ids), k, keys.type)
            long = np.diff(np.asarray(lists.offsets)).astype(np.float64)
            found = pc.index_in(lists.flatten(), value_set=terms)
            at = np.flatnonzero(np.asarray(found.is_valid()))
            doc = np.repeat(np.arange(len(keys)), long.astype(np.int64))[at]
            key, tf = np.unique(doc * len(terms) + np.asarray(found.fill_null(0), dtype=np.int64)[at], return_counts=True)
            doc, term = key // max(1, len(terms)), key % max(1, len(terms))
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * long[doc] / max(mean, 1e-9)))
            size = starts[term + 1] - starts[term]
            edges = np.searchsorted(np.cumsum(size), np.arange(STEP, size.sum() + STEP, STEP))
            edges = np.searchsorted(doc, doc[np.minimum(edges, len(doc) - 1)]) if len(doc) else edges  # whole chunks
            for x, y in zip([0, *edges[edges > 0]], [*edges[edges > 0], len(doc)]):
                if y <= x:
                    continue
                d, s, e = doc[x:y], size[x:y], part[x:y]
                where = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + np.repeat(starts[term[x:y]], s)
                cell = np.repeat(d - d[0], s) * len(ids) + owner[where]
                total = np.bincount(cell, weights=np.repeat(e, s) * weight[where], minlength=0)
                cell = np.unique(cell)
                best.add(cell % len(ids), np.round(total[cell], 6), keys.take(pa.array(cell // len(ids) + d[0])))
        if best is not None and len(ids):
            yield best.rows(ids)

    out = _in_blocks(t, _blocks(q, 64), load, scan, schema, k, False)
    if not keep_zero:
        return out
    some = corpus.select("chunk_id").distinct().orderBy("chunk_id").limit(2 * k)  # of them k at least are in no shorter list
    short = queries.select("query_id").distinct().join(out.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").filter(F.coalesce("n", F.lit(0)) < k)
    rest = short.select("query_id").join(F.broadcast(some)).join(out.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")  # 2 k rows a query
    return top_k(out.select("query_id", "chunk_id", "score").unionByName(rest.withColumn("score", F.lit(0.0))), k)

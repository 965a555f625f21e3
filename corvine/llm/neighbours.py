"""Problem 7: the k most similar vectors of every vector.

Vectors are scaled to length 1, so that distance follows cosine, and hashed by
p-stable projections into the buckets of several tables. A query visits its own
bucket and perturbed ones, the most promising first: hash values next to the
border of their slot are moved over it, in the order of the expected squared
distance to those borders. The candidates of all tables are merged and ranked
by exact cosine.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvine.llm.common import bounded, materialize, read_table, spread

#: Bits of the sketch that goes with each posting.
SKETCH = 63


def probing_order(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """The first perturbation sets by expected score.

    The 2 * hashes borders are numbered by their distance; borders j and
    2 * hashes - 1 - j belong to one hash, so no set holds both.
    """
    m, n = hashes, 2 * hashes
    j = np.arange(1, n + 1)
    z = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - (n + 1 - j) / (m + 1) + (n + 1 - j) * (n + 2 - j) / (4 * (m + 1) * (m + 2)))
    out: list[tuple[int, ...]] = [()]
    heap: list[tuple[float, tuple[int, ...]]] = [(float(z[0]), (0,))]
    while heap and len(out) < probes:
        score, s = heapq.heappop(heap)
        if len(s) == len({min(x, n - 1 - x) for x in s}):
            out.append(s)
        last = s[-1]
        if last + 1 < n:
            heapq.heappush(heap, (score - z[last] + z[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(heap, (score + z[last + 1], (*s, last + 1)))
    return out


class Buckets:
    """Tables of p-stable hashes with query-directed probing."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, probes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.tables, self.hashes = tables, hashes
        self.lines = (rng.standard_normal((dim, tables * hashes)) / width).astype(np.float32)
        self.offset = rng.random(tables * hashes).astype(np.float32)
        self.signs = rng.standard_normal((dim, SKETCH)).astype(np.float32)
        self.mix = rng.integers(1, 1 << 62, size=(tables, hashes), dtype=np.int64) | 1
        order = probing_order(hashes, probes)
        longest = max(map(len, order))
        self.sets = np.array([[*s, *[2 * hashes] * (longest - len(s))] for s in order])

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own buckets ``(n, tables)`` and probed ones ``(n, tables, probes)``.

        Moving hash j by one changes a bucket's key by ``mix[j]``.
        """
        y = (x @ self.lines + self.offset).reshape(len(x), self.tables, self.hashes)
        slot = np.floor(y)
        away = y - slot
        with np.errstate(over="ignore"):
            own = (slot.astype(np.int64) * self.mix).sum(axis=2) + np.arange(self.tables, dtype=np.int64) * np.int64(0x5851F42D4C957F2D)
            border = np.concatenate([away, 1 - away], axis=2)
            order = np.argsort(border, axis=2)
            step = np.concatenate([np.broadcast_to(-self.mix, away.shape), np.broadcast_to(self.mix, away.shape)], axis=2)
            step = np.concatenate([np.take_along_axis(step, order, axis=2), np.zeros((*away.shape[:2], 1), np.int64)], axis=2)
            probed = own[:, :, None] + step[:, :, self.sets].sum(axis=3)
        return own, probed


    def sketch(self, x: np.ndarray) -> np.ndarray:
        """The sides of SKETCH planes on which each vector lies, as bits."""
        return (x @ self.signs > 0) @ (1 << np.arange(SKETCH, dtype=np.int64))


def most_bits(floor: float) -> int:
    """Bits in which the sketches of two vectors at the floor differ at most,
    but for one pair in a thousand (three deviations)."""
    p = math.acos(max(-1.0, min(1.0, floor))) / math.pi
    return min(SKETCH, math.ceil(SKETCH * p + 3 * math.sqrt(SKETCH * p * (1 - p))))


def usable(embedding: str, dim: int):
    """Vectors of ``dim`` finite values that are not all zero."""
    e = F.col(embedding)
    return (F.size(e) == dim) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)


def nearest(
    df: DataFrame, key: str, embedding: str, k: int, floor: float, dim: int = 64,
    tables: int = 3, hashes: int = 16, width: float = 2.0, probes: int = 8, queries: DataFrame | None = None, seed: int = 7,
) -> DataFrame:
    """``(item, neighbour, cosine, rank)``: for each usable vector up to ``k``
    others of the highest cosine, none below ``floor``; ties go by the
    neighbour's key.

    The fewer and shallower the hashes, the wider the net: the defaults are for
    a floor of about 0.95. Only vectors of ``dim`` finite values that are not all
    zero count; repeated rows of a key count once (the least vector). Equal
    vectors share their buckets' work and then stand for themselves. ``queries``
    (keys in a column named as ``key``) limits the items asked for, not those
    found. An empty table gives no rows; further columns are ignored.
    """
    d = df.select(F.col(f"`{key}`").alias("item"), F.col(f"`{embedding}`").cast("array<float>").alias("e")).filter("item is not null").filter(usable("e", dim))
    kind = dict(d.dtypes)["item"]
    buckets = Buckets(dim, tables, hashes, width, probes, seed)

    def unit(b: pa.RecordBatch) -> np.ndarray:
        x = np.asarray(b.column("e").flatten(), dtype=np.float64).reshape(-1, dim)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                e = pa.FixedSizeListArray.from_arrays(pa.array(unit(b).ravel()), dim).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([b.column("item"), e], names=["item", "e"])

    unique = d.mapInArrow(scale, f"item {kind}, e array<float>").withColumn("cls", F.xxhash64("e"))
    one = materialize(unique.groupBy("item").agg(F.min("cls").alias("cls")), "items")
    wanted = one.join(queries.select(F.col(f"`{key}`").alias("item")).distinct(), "item", "left_semi") if queries is not None else one
    # Of rows with equal vectors one works for all.
    again = bounded(materialize(unique.groupBy("cls").count().filter("count > 1").select("cls"), "copies"))
    single = unique.join(again, "cls", "left_anti").select("cls", "e")
    copied = unique.join(again, "cls", "left_semi")
    reps = single.unionByName(copied.groupBy("cls").agg(F.first("e").alias("e")))
    asked = reps.join(wanted.select("cls").distinct(), "cls", "left_semi") if queries is not None else reps
    apart = most_bits(floor)

    def post(batches: Iterator[pa.RecordBatch], probe: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                x = np.asarray(part.column("e").flatten(), dtype=np.float32).reshape(-1, dim)
                own, probed = buckets.keys(x)
                keys = probed.reshape(len(x), -1) if probe else own
                cls, bits = (np.repeat(v, keys.shape[1]) for v in (np.asarray(part.column("cls")), buckets.sketch(x)))
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(keys.ravel()), pa.array(bits)], names=["cls", "bucket", "bits"])

    posting = "cls bigint, bucket bigint, bits bigint"
    posts = reps.mapInArrow(lambda x: post(x, False), posting)
    asks = asked.mapInArrow(lambda x: post(x, True), posting)
    a, b = asks.alias("a"), posts.alias("b")
    close = F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= apart
    pairs = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.cls") != F.col("b.cls")) & close).select(F.col("a.cls").alias("x"), F.col("b.cls").alias("y"))
    if queries is None:  # either side may have found the other
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    pairs = materialize(pairs.distinct(), "pairs")
    paired = materialize(pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct(), "paired")
    ends = reps.join(bounded(paired), "cls", "left_semi")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p, q = (np.asarray(b.column(c).flatten(), dtype=np.float64).reshape(-1, dim) for c in ("p", "q"))
                c = (p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(c)], names=["x", "y", "cosine"]).filter(pa.array(c >= floor))

    rated = pairs.join(ends.select(F.col("cls").alias("x"), F.col("e").alias("p")), "x").join(ends.select(F.col("cls").alias("y"), F.col("e").alias("q")), "y").mapInArrow(rate, "x bigint, y bigint, cosine double")
    rated = materialize(rated, "rated")
    if queries is None:
        rated = rated.unionByName(rated.select(F.col("y").alias("x"), F.col("x").alias("y"), "cosine"))
    # A class can fill a list by itself, so k of its members are enough of it.
    per = W.partitionBy("cls").orderBy("item")
    few = one.select("cls", "item").withColumn("n", F.row_number().over(per)).filter(F.col("n") <= k + 1)
    best = W.partitionBy("x").orderBy(F.desc("cosine"), "y")
    near = rated.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).select("x", "y", "cosine").unionByName(reps.select(F.col("cls").alias("x"), F.col("cls").alias("y"), F.lit(1.0).alias("cosine")))
    listed = near.join(few.select(F.col("cls").alias("y"), F.col("item").alias("neighbour")), "y").withColumn("n", F.row_number().over(W.partitionBy("x").orderBy(F.desc("cosine"), "neighbour"))).filter(F.col("n") <= k + 1)
    own = wanted.select("item", F.col("cls").alias("x"))
    rank = W.partitionBy("item").orderBy(F.desc("cosine"), "neighbour")
    return own.join(listed.select("x", "neighbour", "cosine"), "x").filter("item <> neighbour").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("item", "neighbour", "cosine", "rank")


def found_query(spark: SparkSession, base: str) -> DataFrame:
    vectors = spread(read_table(spark, base, "chunk_vectors"))
    near = nearest(vectors, "chunk_id", "embedding", k=10, floor=0.95)
    return near.select(F.least("item", "neighbour").alias("chunk_id_a"), F.greatest("item", "neighbour").alias("chunk_id_b")).distinct()


def nearest_query(spark: SparkSession, base: str) -> DataFrame:
    """The ten nearest, however far, of every vector whose document's number is
    divisible by 100, against all vectors.

    These vectors have no structure at that distance: hashing would have to rank
    close to half of them for a recall of 0.9, so the search is exact, in blocks.
    """
    from corvine.operators.search import vector_top_k

    v = spread(read_table(spark, base, "chunk_vectors")).filter(usable("embedding", 64)).groupBy("chunk_id").agg(F.min("embedding").alias("embedding"))
    asked = v.filter(F.regexp_extract("chunk_id", r"-(\d{9})", 1).try_cast("bigint") % 100 == 0)
    near = vector_top_k(v, asked.withColumnRenamed("chunk_id", "query_id"), 10, exclude_self=True)
    return near.select(F.col("query_id").alias("chunk_id"), F.col("chunk_id").alias("neighbour"), F.round("score", 4).alias("cosine"), "rank")

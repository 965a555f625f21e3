"""Stores of chunks with vectors: what every store offers, one on Parquet, and a
registry of kinds by name.

The Parquet store appends: an upsert writes only its own rows, a deletion only
the keys that are gone, each in a segment with a number. A segment counts once
its mark has been renamed into place, so readers see a whole one or none, and
readers that have begun keep what they saw. ``compact`` folds segments into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.operators.search import vector_top_k

SCHEMA = "chunk_id string, collection_id string, filename string, chunk_index int, content string, metadata string, embedding array<float>"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class IntegrityError(ValueError):
    """Vectors are missing or of another length than the collection's."""


class Store(Protocol):
    """What search and ingest need of a store."""

    def add(self, chunks: DataFrame) -> None: ...

    def search(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame: ...

    def delete_chunks(self, ids: DataFrame) -> None: ...

    def delete_file(self, filename: str, collection_id: str | None = None) -> None: ...

    def stats(self) -> DataFrame: ...


class ChunkStore:
    """``metric`` is ``cosine``, ``l2`` (scores ``1 / (1 + d)``) or
    ``cosine_distance`` (``1 - d``, which is the cosine again)."""

    def __init__(self, spark: SparkSession, path: str, dimension: int, metric: str = "cosine"):
        if metric not in ("cosine", "l2", "cosine_distance"):
            raise ValueError(f"unknown metric {metric}")
        self.spark, self.path, self.dimension, self.metric = spark, path.rstrip("/"), dimension, "l2" if metric == "l2" else "cosine"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _segments(self) -> list[str]:
        """Names of whole segments in their order, from the last compacted one on."""
        p, fs = self._fs(f"{self.path}/done")
        names = sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
        base = max((i for i, n in enumerate(names) if n.endswith("-base")), default=0)
        return names[base:]

    def _write(self, df: DataFrame, kind: str) -> None:
        p, fs = self._fs(f"{self.path}/done")
        last = max([int(x.getPath().getName().split("-")[0]) for x in fs.listStatus(p)] if fs.exists(p) else [0])
        own = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{own}")
        mark, fs = self._fs(f"{self.path}/new/{own}")
        fs.create(mark, False).close()
        fs.mkdirs(p)
        while True:  # whoever renames first has the number
            last += 1
            to, _ = self._fs(f"{self.path}/done/{last:09}-{own}-{kind}")
            if not any(x.getPath().getName().startswith(f"{last:09}-") for x in fs.listStatus(p)) and fs.rename(mark, to):
                return

    def read(self) -> DataFrame:
        """The newest row of each chunk that is not deleted."""
        seen = self._segments()
        if not seen:
            return self.spark.createDataFrame([], SCHEMA)
        if len(seen) == 1:
            return self._data(seen[0])
        rows, gone = None, None
        for k, s in enumerate(seen):
            if s.endswith("-gone"):
                d = self.spark.read.schema("collection_id string, chunk_id string, filename string").parquet(f"{self.path}/data/{s.split('-')[1]}").withColumn("_gone", F.lit(k))
                gone = d if gone is None else gone.unionByName(d)
            else:
                d = self._data(s).withColumn("_n", F.lit(k))
                rows = d if rows is None else rows.unionByName(d)
        newest = rows.withColumn("_k", F.row_number().over(W.partitionBy("collection_id", "chunk_id").orderBy(F.desc("_n")))).filter("_k = 1").drop("_k")
        if gone is not None:
            for on in ("chunk_id", "filename"):
                mine = gone.filter(F.col(on).isNotNull()).select(F.col("collection_id").alias("_c"), F.col(on).alias("_x"), "_gone")
                hit = (F.col(on) == F.col("_x")) & (F.col("_c").isNull() | (F.col("collection_id") == F.col("_c"))) & (F.col("_n") < F.col("_gone"))
                newest = newest.join(mine, hit, "left_anti")
        return newest.select(*_COLUMNS)

    def _data(self, segment: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/data/{segment.split('-')[1]}").select(*_COLUMNS)

    def _check(self, df: DataFrame) -> None:
        if not df.filter(F.col("embedding").isNull() | (F.size("embedding") != self.dimension)).isEmpty():
            raise IntegrityError(f"every vector must have {self.dimension} values")

    def add(self, chunks: DataFrame) -> None:
        """Insert chunks, replacing those of the same collection and id. Of equal
        ids in one call the one with the later index counts."""
        self._check(chunks)
        w = W.partitionBy("collection_id", "chunk_id").orderBy(F.desc("chunk_index"), F.desc("content"))
        one = chunks.select(*_COLUMNS).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
        self._write(one.sortWithinPartitions("collection_id", "filename"), "rows")

    def _gone(self, df: DataFrame) -> None:
        self._check(self.read())
        self._write(df, "gone")

    def delete_chunks(self, ids: DataFrame) -> None:
        """Delete by ``chunk_id`` (and ``collection_id`` if given); refuses,
        changing nothing, where vectors are unsound. Unknown ids change nothing."""
        coll = F.col("collection_id") if "collection_id" in ids.columns else F.lit(None)
        self._gone(ids.select(coll.cast("string").alias("collection_id"), "chunk_id", F.lit(None).cast("string").alias("filename")).distinct())

    def delete_file(self, filename: str, collection_id: str | None = None) -> None:
        """Delete a file's chunks, under the same guard."""
        self._gone(self.spark.createDataFrame([(collection_id, None, filename)], "collection_id string, chunk_id string, filename string"))

    def compact(self) -> None:
        """Fold all segments into one that later reads begin with."""
        self._write(self.read().repartition("collection_id", F.pmod(F.xxhash64("chunk_id"), F.lit(64))), "base")

    def search(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """The k best of each query among chunks that pass ``where``, which is
        applied before ranking."""
        c = self.read()
        return vector_top_k(c if where is None else c.filter(where), queries, k, metric=self.metric)

    def search_chunks(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """As ``search``, with the chunks' own columns."""
        return self.search(queries, k, where).join(self.read().drop("embedding"), "chunk_id")

    def file_chunks(self, filename: str) -> DataFrame:
        return self.read().filter(F.col("filename") == filename).orderBy("chunk_index")

    def stats(self) -> DataFrame:
        return self.read().groupBy("collection_id").agg(F.count("*").alias("chunks"), F.count_distinct("filename").alias("files"))


#: Kinds of stores by name; add one of your own with the same signature.
STORES: dict[str, Callable[[SparkSession, str, int], Store]] = {
    "parquet": ChunkStore,
    "cosine": ChunkStore,
    "l2": lambda spark, path, dimension: ChunkStore(spark, path, dimension, "l2"),
    "cosine_distance": lambda spark, path, dimension: ChunkStore(spark, path, dimension, "cosine_distance"),
}


def open_store(kind: str, spark: SparkSession, path: str, dimension: int) -> Store:
    """A store of a kind; each collection is told by its column, so one path serves all."""
    if kind not in STORES:
        raise ValueError(f"unknown store {kind}; there are {', '.join(sorted(STORES))}")
    return STORES[kind](spark, path, dimension)

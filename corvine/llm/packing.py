"""Problem 8: filling containers of fixed capacity.

Documents are thrown into random groups, and each group is packed by itself:
first-fit decreasing, the first container with enough room being found in a
tournament tree over the containers' room. A group has a bounded number of
items whatever the collection's size, so packing never sees a hot key; what
many groups lose against one is at most a container each.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import cut_batches, read_table, spread

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a ranks file, once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class FirstFit:
    """Containers in order of opening, with the most room of any range of them."""

    def __init__(self, capacity: int, leaves: int):
        self.capacity, self.opened = capacity, 0
        self.size = 1 << max(0, leaves - 1).bit_length()
        self.room = [capacity] * (2 * self.size)

    def put(self, item: int) -> int:
        room, i = self.room, 1
        while i < self.size:
            i *= 2
            if room[i] < item:
                i += 1
        at = i - self.size
        room[i] -= item
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        self.opened = max(self.opened, at + 1)
        return at


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, first-fit decreasing; equal sizes keep their order."""
    order = np.argsort(-sizes, kind="stable")
    tree, to = FirstFit(capacity, max(1, len(sizes))), np.zeros(len(sizes), dtype=np.int32)
    for i in order.tolist():
        to[i] = tree.put(int(sizes[i]))
    return to


def count_tokens(df: DataFrame, key: str, text: str, ranks: str = RANKS) -> DataFrame:
    """``(item, n_tokens)``; null texts have no tokens. The ranks file is sent to
    the executors from where the driver has it."""
    df.sparkSession.sparkContext.addFile(ranks)
    d = df.select(F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").alias("body"))
    kind = dict(d.dtypes)["item"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(SparkFiles.get(os.path.basename(ranks))).encode_ordinary
        for b in cut_batches(batches, "body"):
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.array([len(encode(x)) if x else 0 for x in b.column("body").to_pylist()], pa.int64())], names=["item", "n_tokens"])

    return d.mapInArrow(count, f"item {kind}, n_tokens bigint")


def fill_containers(df: DataFrame, key: str, size: str, capacity: int = 2048, group_items: int = 8000, seed: int = 8, items: int | None = None) -> DataFrame:
    """``(item, part_no, first_token, n_tokens, group_no, container_no)``.

    An item larger than the capacity leaves as full containers of its own and
    a last part that is packed like any item; no other item is split. Items of
    size 0 or null are put with the rest and take no room. Repeated rows are
    items of their own. Ties go by key. An empty table gives no rows. ``items``
    is the number of rows where the caller knows it cheaply; else it is counted.
    """
    d = df.select(F.col(f"`{key}`").alias("item"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    groups = max(1, -(-(d.count() if items is None else items) // group_items))
    kind = dict(d.dtypes)["item"]
    d = d.withColumn("group_no", F.pmod(F.xxhash64(F.lit(seed), "item"), F.lit(groups)).cast("int"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n", "item"], ascending=[False, True], kind="stable")
        n = g["n"].to_numpy()
        whole = np.where(n > capacity, n // capacity, 0)
        rest = n - whole * capacity
        some = (rest > 0) | (whole == 0)
        full = np.repeat(np.arange(len(n)), whole)
        part = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
        index = np.concatenate([full, np.flatnonzero(some)])
        part = np.concatenate([part, whole[some]])
        room = np.concatenate([np.full(len(full), capacity), rest[some]])
        to = np.concatenate([np.arange(len(full)), len(full) + pack(rest[some], capacity)])
        return pd.DataFrame({"item": g["item"].to_numpy()[index], "part_no": part, "first_token": part * capacity, "n_tokens": room, "group_no": g["group_no"].iloc[0], "container_no": to})

    return d.groupBy("group_no").applyInPandas(one, f"item {kind}, part_no int, first_token bigint, n_tokens bigint, group_no int, container_no int")


def packing_query(spark: SparkSession, base: str) -> DataFrame:
    d = read_table(spark, base, "documents").select("doc_id", "text")
    sizes = count_tokens(spread(d), "doc_id", "text")
    return fill_containers(sizes, "item", "n_tokens", items=d.count()).withColumnRenamed("item", "doc_id")

"""Problem 9: passages of evaluation items inside corpus documents.

Every item is cut into all its windows of ``run`` words. Without edits a random
walk over a window's words (CGK embedding) with sampled positions hashed is its
key; windows of the documents take the same walk, equal keys are candidates, and
each is verified word by word. With edits a window is cut into one part more than
there may be edits: one part at least stands unchanged in the document and is
looked up by hash, and the window is aligned to the words around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import WORD, cut_batches, read_table, spread

#: Characters of items held by a worker at once; larger item sets go in blocks, each against all documents.
BLOCK_CHARS = 4_000_000


class Walks:
    """CGK embeddings of word windows with sampled positions hashed to keys."""

    def __init__(self, run: int, count: int, sampled: int, seed: int, edits: int):
        rng = np.random.default_rng(seed)
        self.run, self.steps = run, 3 * run
        self.bits = rng.integers(0, 1 << 62, size=(count, self.steps), dtype=np.int64)
        self.picks = [np.sort(rng.choice(2 * run, size=sampled, replace=False)) for _ in range(count)]
        self.factor = rng.integers(1, 1 << 62, size=sampled, dtype=np.int64) | 1

    def keys(self, ids: np.ndarray, starts: np.ndarray, walk: int) -> np.ndarray:
        """The key of each window ``ids[start : start + run]`` under one walk."""
        at = np.zeros(len(starts), dtype=np.int64)
        key = np.zeros(len(starts), dtype=np.int64)
        picks = self.picks[walk].tolist()
        with np.errstate(over="ignore"):
            for step in range(picks[-1] + 1):
                inside = at < self.run
                symbol = np.where(inside, ids[starts + np.minimum(at, self.run - 1)], -1)
                if step in picks:
                    key = (key ^ (symbol + 2)) * self.factor[picks.index(step)]
                    key ^= key >> 29
                mixed = (symbol + 3) * self.bits[walk, step]
                at += ((mixed >> 33) ^ (mixed >> 17)) & 1
        return key


def aligned(at: np.ndarray, begin: np.ndarray, item_ids: np.ndarray, starts: np.ndarray, run: int, edits: int) -> np.ndarray:
    """Whether each item window ``item_ids[start : start + run]`` is at most
    ``edits`` words inserted, dropped or changed from any stretch of ``at`` about
    ``begin`` (``edits`` words sooner or later, of any length)."""
    item = item_ids[starts[:, None] + np.arange(run)]
    row = np.broadcast_to(np.arange(run + 1, dtype=np.int16), (len(begin), run + 1)).copy()
    best = row[:, run].copy()
    for i in range(-edits, run + 2 * edits):
        where = begin + i
        word = np.where((where >= 0) & (where < len(at)), at[np.clip(where, 0, len(at) - 1)], -1)
        new = np.empty_like(row)
        new[:, 0] = 0
        change = row[:, :-1] + (item != word[:, None])
        for j in range(1, run + 1):
            new[:, j] = np.minimum(np.minimum(change[:, j - 1], row[:, j] + 1), new[:, j - 1] + 1)
        row = new
        best = np.minimum(best, row[:, run])
    return best <= edits


def _grams(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``size`` words from each start."""
    key = np.zeros(len(starts), dtype=np.int64)
    with np.errstate(over="ignore"):
        for k in range(size):
            key = (key ^ (ids[starts + k] + 2)) * np.int64(0x1E3779B97F4A7C15)
            key ^= key >> 29
    return key


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    run: int = 10, max_edits: int = 0, sampled: int = 8, seed: int = 9,
) -> DataFrame:
    """``(doc_id, item_id)`` of documents holding ``run`` successive words of an
    item, up to ``max_edits`` words inserted, dropped or changed among them.

    Words are runs of letters, digits and underscores of the lower-cased text.
    The result is exact. ``max_edits`` is below ``run``. Items shorter than
    ``run`` words, null and empty texts match nothing; repeated rows count
    once; further columns are ignored, whatever their names. The items are a
    query set: they go in blocks of at most ``BLOCK_CHARS`` characters, each
    block against all documents.
    """
    spark = docs.sparkSession
    queries = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{item_text}`").alias("body")).filter("item is not null and body is not null").distinct()
    d = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("body")).filter(f"char_length(body) >= {2 * (run - max_edits) - 1}")
    kinds = {"doc": dict(d.dtypes)["doc"], "item": dict(queries.dtypes)["item"]}
    found = None
    block: list[tuple] = []
    held = 0
    blocks = []
    for row in queries.toLocalIterator():
        if block and held + len(row.body) > BLOCK_CHARS:
            blocks.append(block)
            block, held = [], 0
        block.append((row.item, row.body))
        held += len(row.body)
    blocks.append(block)
    for one in blocks:
        part = _scan(d, one, kinds, run, max_edits, sampled, seed)
        found = part if found is None else found.unionByName(part)
    return found.distinct().select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def _scan(d: DataFrame, block: list[tuple], kinds: dict, run: int, max_edits: int, sampled: int, seed: int) -> DataFrame:
    walks = Walks(run, 1, sampled, seed, max_edits)
    size = run // (max_edits + 1)
    vocabulary: dict[str, int] = {}
    ids: list[int] = []
    owner: list[int] = []
    starts: list[int] = []
    for k, (_, body) in enumerate(block):
        words = WORD.findall(body.lower())
        starts += range(len(ids), len(ids) + len(words) - run + 1)
        ids += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        owner += [k] * len(words)
    item_ids, item_starts = np.asarray(ids, dtype=np.int64), np.asarray(starts, dtype=np.int64)
    tables = []
    for w in range(max_edits + 1):
        keys = np.zeros(0, np.int64) if not starts else _grams(item_ids, item_starts + w * size, size) if max_edits else walks.keys(item_ids, item_starts, w)
        order = np.argsort(keys, kind="stable")
        tables.append((keys[order], item_starts[order]))
    names = [x for x, _ in block]
    schema = pa.schema([("doc", _arrow(kinds["doc"])), ("item", _arrow(kinds["item"]))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, "body"):
            flat: list[int] = []
            ends: list[int] = []
            get = vocabulary.get
            for body in batch.column("body").to_pylist():
                flat.extend(map(get, WORD.findall(body.lower()), repeat(-1)))
                flat.extend(_GAP[: max_edits + 1])
                ends.append(len(flat))
            at = np.asarray(flat, dtype=np.int64)
            length = size if max_edits else run
            if len(at) < length:
                continue
            # A word that no item has is in no unchanged part.
            foreign = np.concatenate([[0], np.cumsum(at < 0)])
            begin = np.flatnonzero(foreign[length:] == foreign[:-length])
            grams = _grams(at, begin, size) if max_edits else None
            rows: set[tuple[int, int]] = set()
            for w, (keys, where) in enumerate(tables):
                if not len(begin) or not len(keys):
                    break
                mine = grams if max_edits else walks.keys(at, begin, w)
                lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                hit = np.flatnonzero(hi > lo)
                width = (hi - lo)[hit]
                a = np.repeat(begin[hit], width)
                offset = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                b = where[np.repeat(lo[hit], width) + offset]
                if max_edits == 0:
                    good = (at[a[:, None] + np.arange(run)] == item_ids[b[:, None] + np.arange(run)]).all(axis=1)
                else:
                    a = a - w * size
                    good = np.concatenate([aligned(at, a[x : x + 50_000], item_ids, b[x : x + 50_000], run, max_edits) for x in range(0, len(a), 50_000)] or [np.zeros(0, dtype=bool)])
                    a = a + w * size
                doc = np.searchsorted(np.asarray(ends), a[good], side="right")
                rows.update(zip(doc.tolist(), (owner[y] for y in b[good].tolist())))
            if rows:
                pairs = sorted(rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array([x for x, _ in pairs])), pa.array([names[y] for _, y in pairs], schema.field("item").type)], schema=schema)

    return d.mapInArrow(scan, f"doc {kinds['doc']}, item {kinds['item']}")


_GAP = [-1] * 64


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def found_query(spark: SparkSession, base: str) -> DataFrame:
    return find_leaks(spread(read_table(spark, base, "documents").select("doc_id", "text")), read_table(spark, base, "eval_items"))


def edited_query(spark: SparkSession, base: str) -> DataFrame:
    """Passages of 13 words of an item, up to two words edited."""
    return find_leaks(spread(read_table(spark, base, "documents").select("doc_id", "text")), read_table(spark, base, "eval_items"), run=13, max_edits=2, sampled=5)

"""Problem 3: near-duplicate texts by a MinHash LSH forest.

A text is the set of its word sequences of a given length. Each tree of the
forest gives every text a label of MinHash values of its own, and sorted labels
are a prefix trie: texts that share a prefix stand together. Two texts are
candidates if they share a prefix that is long enough. How long that is the trie
decides node by node: it is shortened from the full label as long as the node
stays small, down to the depth at which all trees together reach the target
recall at the threshold. Texts in nodes too crowded to be shortened that far,
as boilerplate makes them, are joined exactly by prefixes of rare sequences
instead, so no pair is lost. All candidates are verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import WORD, bounded, chunks, cut_batches, materialize

#: Texts in a node of a trie from which its prefix is not shortened further.
CROWD = 1000
#: Values in a label. With the tree's number, a byte each, they make up 64 bits.
LABEL = 7

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def prefix_depth(trees: int, threshold: float, recall: float, label: int) -> int:
    """The longest prefix of a label with which two texts at the threshold meet
    in some tree with probability ``recall``."""
    for depth in range(label, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


class Shingler:
    """Sets of word sequences as sorted 64-bit values; words are hashed once a worker."""

    def __init__(self, width: int, min_words: int):
        self.width, self.min_words, self.known = width, min_words, {}

    def _hash(self, word: str) -> int:
        h = self.known.get(word)
        if h is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            h = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def words(self, text: str | None) -> list[str] | None:
        words = WORD.findall(text.lower()) if text else []
        return words if len(words) >= max(self.min_words, self.width) else None

    def __call__(self, words: list[str]) -> np.ndarray:
        h = np.fromiter(map(self._hash, words), dtype=np.uint64, count=len(words))
        s = np.zeros(len(h) - self.width + 1, dtype=np.uint64)
        for i in range(self.width):
            s = (s ^ h[i : i + len(s)]) * _A
            s ^= s >> np.uint64(31)
        return np.unique(s)


def class_id(words: list[str]) -> int:
    """One value for texts of equal words."""
    return xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63)


#: Bits of the sketch that goes with each posting.
SKETCH = 64


def least_bits(threshold: float) -> int:
    """Bits in which the sketches of two texts at the threshold agree at least,
    but for one pair in about a thousand (3.2 deviations)."""
    p = (1 + threshold) / 2
    return max(0, int(SKETCH * p - 3.2 * (SKETCH * p * (1 - p)) ** 0.5))


class Forest:
    """Labels of ``LABEL`` MinHash values, a byte each, behind the tree's number."""

    def __init__(self, trees: int, seed: int):
        if trees > 256:
            raise ValueError("at most 256 trees")
        rng = np.random.default_rng(seed)
        self.trees = trees
        n = trees * LABEL + SKETCH
        self.a = (rng.integers(0, 1 << 32, size=n, dtype=np.uint64).astype(np.uint32)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, size=n, dtype=np.uint64).astype(np.uint32)

    def labels(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row per set (``flat`` cut at ``starts``) with its label in each tree,
        and sketches: a bit each of further MinHash values."""
        low = ((flat * _B) >> np.uint64(32)).astype(np.uint32)
        out = np.empty((self.trees, len(starts)), dtype=np.uint64)
        work = np.empty_like(low)
        k = 0
        for t in range(self.trees):
            key = np.full(len(starts), t, dtype=np.uint64)
            for _ in range(LABEL):
                np.multiply(low, self.a[k], out=work)
                np.bitwise_xor(work, self.b[k], out=work)
                least = np.minimum.reduceat(work, starts) * np.uint32(0x9E3779B1)
                key = (key << np.uint64(8)) | (least >> np.uint32(24))
                k += 1
            out[t] = key
        sketch = np.zeros(len(starts), dtype=np.uint64)
        for k in range(k, k + SKETCH):
            np.multiply(low, self.a[k], out=work)
            np.bitwise_xor(work, self.b[k], out=work)
            sketch = (sketch << np.uint64(1)) | ((np.minimum.reduceat(work, starts) * np.uint32(0x9E3779B1)) >> np.uint32(31))
        return out.T, sketch


class Trie:
    """Descends sorted labels, which come in pieces. ``feed`` gives the candidate
    pairs of nodes that are complete and, as pairs with themselves, the members
    of crowded ones; it holds at most a node of ``crowd`` texts and a piece."""

    def __init__(self, depth: int, crowd: int, ratio: float, bits: int):
        self.depth, self.crowd, self.ratio, self.bits = depth, crowd, ratio, bits
        self.held: tuple[np.ndarray, ...] = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int32, np.uint64))
        self.at = depth  # where the node that is still open is cut; all shallower ones it is in are crowded
        self.before, self.full = np.uint64(0), False  # the last label, and whether it is crowded as a whole

    def feed(self, label: np.ndarray, cls: np.ndarray, n: np.ndarray, sketch: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        if self.at > self.depth and len(label):  # the open node is crowded: so are the rows that go on with it
            more = self._prefix(label, self.depth) == self._prefix(self.before, self.depth)
            out.append((cls[more], cls[more]))
            if self.full:
                rest = label != self.before
                label, cls, n, sketch = label[rest], cls[rest], n[rest], sketch[rest]
                if len(label):
                    self._leave(self.before, label[0])
        rows = tuple(np.concatenate(x) for x in zip(self.held, (label, cls, n, sketch)))
        size = len(rows[0])
        while size:
            # Below a crowded node only the rest of it is cut at this depth.
            edge = size if self.at == self.depth else int(np.searchsorted(self._prefix(rows[0], self.at - 1), self._prefix(rows[0][0], self.at - 1), side="right"))
            if edge < size:
                part = tuple(x[:edge] for x in rows)
                self._nodes(part, self._runs(part[0], self.at), self.at, out)
                self._leave(rows[0][edge - 1], rows[0][edge])
                rows = tuple(x[edge:] for x in rows)
                size = len(rows[0])
                continue
            if last:
                self._nodes(rows, self._runs(rows[0], self.at), self.at, out)
                rows = tuple(x[size:] for x in rows)
                break
            runs = self._runs(rows[0], self.at)
            done = runs[-1]  # the last node may go on in the next piece
            if done:
                self._nodes(tuple(x[:done] for x in rows), runs[:-1], self.at, out)
                self._leave(rows[0][done - 1], rows[0][done])
                rows = tuple(x[done:] for x in rows)
            elif size > self.crowd:
                out.append((rows[1], rows[1]))
                self.before = rows[0][-1]
                if self.at == LABEL:
                    self.full = True
                    rows = tuple(x[size:] for x in rows)
                    break
                self.at += 1
            else:
                break
            size = len(rows[0])
        self.held = rows
        if len(rows[0]):
            self.before = rows[0][-1]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))

    def _leave(self, old, new) -> None:
        """Find the crowded nodes that the next row is still in."""
        same = [d for d in range(self.depth, self.at) if self._prefix(old, d) == self._prefix(new, d)]
        self.at, self.full = max(same) + 1 if same else self.depth, False

    @staticmethod
    def _prefix(label, depth: int):
        return label >> np.uint64(8 * (LABEL - depth))

    def _runs(self, label: np.ndarray, depth: int) -> np.ndarray:
        p = self._prefix(label, depth)
        return np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1])

    def _nodes(self, rows: tuple, starts: np.ndarray, depth: int, out: list) -> None:
        """Complete nodes of one depth: pairs within small ones, a descent into others."""
        label, cls, n, sketch = rows
        sizes = np.diff(np.append(starts, len(label)))
        for k in np.flatnonzero(sizes > self.crowd).tolist():
            a, b = int(starts[k]), int(starts[k] + sizes[k])
            out.append((cls[a:b], cls[a:b]))
            if depth < LABEL:
                part = tuple(x[a:b] for x in rows)
                self._nodes(part, self._runs(part[0], depth + 1), depth + 1, out)
        left = np.where(sizes > self.crowd, 0, sizes)
        room = np.repeat(starts + left, sizes) - np.arange(len(label))  # rows from here to the node's end
        at = np.flatnonzero(room > 1)
        step = 1
        while len(at):
            x, y = at, at + step
            good = (n[x] >= n[y] * self.ratio) & (n[y] >= n[x] * self.ratio) & (cls[x] != cls[y])
            x, y = x[good], y[good]
            good = np.bitwise_count(sketch[x] ^ sketch[y]) <= SKETCH - self.bits
            x, y = cls[x[good]], cls[y[good]]
            out.append((np.minimum(x, y), np.maximum(x, y)))
            step += 1
            at = at[room[at] > step]


def _exact_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """``(cls_a, cls_b)`` holding every pair of ``sets(cls, s)`` that may be alike:
    two such sets share one of the rarest sequences of either."""
    t = sets.select("cls", F.size("s").alias("n"), F.explode("s").alias("tok"))
    rare = t.join(t.groupBy("tok").agg(F.count("*").alias("df")), "tok").filter("df > 1")
    order = rare.groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("o"))
    # Sequences of one set only are the rarest of it and meet nothing.
    alone = F.col("n") - F.size("o")
    prefix = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1 - alone)
    posts = order.select("cls", "n", F.explode(F.slice("o.tok", F.lit(1), prefix)).alias("tok"))
    a, b = posts.alias("a"), posts.alias("b")
    near = (F.col("a.n") >= F.col("b.n") * threshold) & (F.col("b.n") >= F.col("a.n") * threshold)
    return a.join(b, (F.col("a.tok") == F.col("b.tok")) & (F.col("a.cls") < F.col("b.cls")) & near).select(F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b"))


def near_duplicates(
    df: DataFrame, key: str, text: str, width: int = 5, threshold: float = 0.8, min_words: int = 0, trees: int = 57, recall: float = 0.985, crowd: int = CROWD, seed: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts and the links between them.

    Returns ``members(item, cls)``, every usable item with the class of texts of
    the same words, and ``links(cls_a, cls_b, similarity)`` with
    ``cls_a < cls_b`` for all classes at least ``threshold`` alike. Texts that
    are null, empty or shorter than ``min_words`` (or the sequence) belong to
    no class. Repeated rows count once; an item with several texts is in the
    class of each. Further columns are ignored, whatever their names.
    """
    depth = prefix_depth(trees, threshold, recall, LABEL)
    forest = Forest(trees, seed)
    d = df.select(F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").alias("body"))
    kind = dict(d.dtypes)["item"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width, min_words)
        for b in cut_batches(batches, "body"):
            words = list(map(shingle.words, b.column("body").to_pylist()))
            index = pa.array([i for i, w in enumerate(words) if w], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("item").take(index), b.column("th").take(index), pa.array([class_id(w) for w in words if w], pa.int64())], names=["item", "th", "cls"])

    d = d.withColumn("th", F.xxhash64("body"))
    seen = materialize(d.mapInArrow(read, f"item {kind}, th bigint, cls bigint"), "classes")
    members = seen.select("item", "cls").distinct()
    # Of texts of equal words one goes into the trees.
    copied = seen.groupBy("cls").agg(F.min(F.struct("item", "th")).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    extra = materialize(seen.distinct().join(copied, "cls").filter(F.struct("item", "th") != F.col("first")).select("item", "th").distinct(), "copies")
    single = d.join(bounded(extra), ["item", "th"], "left_anti")

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width, min_words)
        for b in cut_batches(batches, "body", 1_000_000):
            words = [w for w in map(shingle.words, b.column("body").to_pylist()) if w]
            if not words:
                continue
            sets = list(map(shingle, words))
            sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            labels, sketch = forest.labels(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            cls, n, sketch = (np.repeat(x, trees) for x in (np.array([class_id(w) for w in words]), sizes.astype(np.int32), sketch.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(labels.ravel().view(np.int64)), pa.array(cls), pa.array(n), pa.array(sketch)], names=["label", "cls", "n", "sketch"])

    posts = single.select("body").mapInArrow(plant, "label bigint, cls bigint, n int, sketch bigint")
    posts = posts.repartition(F.shiftrightunsigned("label", 8 * (LABEL - depth))).sortWithinPartitions("label")

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(depth, crowd, threshold, least_bits(threshold))
        names = ["cls_a", "cls_b"]
        none = pa.record_batch([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64())], names=["label", "cls", "n", "sketch"])
        for last, b in chain(((False, b) for b in batches), [(True, none)]):
            x, y = trie.feed(np.asarray(b.column("label")).astype(np.int64).view(np.uint64), np.asarray(b.column("cls")), np.asarray(b.column("n")), np.asarray(b.column("sketch")).astype(np.int64).view(np.uint64), last)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=names)

    pairs = materialize(posts.mapInArrow(descend, "cls_a bigint, cls_b bigint").distinct(), "pairs")

    wanted = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    rep = materialize(seen.select("item", "cls").join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("item").alias("item")), "rep")
    ids = bounded(rep.select("item"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width, min_words)
        for b in cut_batches(batches, "body"):
            words = [w for w in map(shingle.words, b.column("body").to_pylist()) if w]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(class_id, words)), pa.int64()), pa.array([shingle(w).view(np.int64) for w in words], pa.list_(pa.int64()))], names=["cls", "s"])

    sets = d.select("item", "body").join(ids, "item", "left_semi").mapInArrow(again, "cls bigint, s array<bigint>").groupBy("cls").agg(F.first("s").alias("s"))
    sets = materialize(sets, "sets")
    crowded = pairs.filter("cls_a = cls_b").select(F.col("cls_a").alias("cls"))
    pairs = pairs.filter("cls_a <> cls_b")
    if not crowded.isEmpty():
        pairs = materialize(pairs.union(_exact_pairs(sets.join(crowded, "cls", "left_semi"), threshold)).distinct(), "pairs")
    x = pairs.join(sets.select(F.col("cls").alias("cls_a"), F.col("s").alias("sa")), "cls_a").join(sets.select(F.col("cls").alias("cls_b"), F.col("s").alias("sb")), "cls_b")
    both = F.size(F.array_intersect("sa", "sb"))
    x = x.withColumn("similarity", both / (F.size("sa") + F.size("sb") - both)).filter(F.col("similarity") >= threshold)
    return members, materialize(x.select("cls_a", "cls_b", "similarity"), "links")


def item_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Links of classes as all pairs of their items, equal texts included."""
    m, n = members.alias("m"), members.alias("n")
    within = m.join(n, (F.col("m.cls") == F.col("n.cls")) & (F.col("m.item") < F.col("n.item"))).select(F.col("m.item").alias("a"), F.col("n.item").alias("b"))
    across = links.join(members.withColumnsRenamed({"cls": "cls_a", "item": "x"}), "cls_a").join(members.withColumnsRenamed({"cls": "cls_b", "item": "y"}), "cls_b").filter("x <> y")
    return within.unionByName(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of the nodes of ``edges(u, v)`` with the least node each is
    connected to; large and small stars in turn, so rounds grow with the logarithm
    of the nodes. Every round is written out."""
    e = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    last, now = None, state(e)
    while now != last:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        e = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = materialize(e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct(), "edges")
        last, now = now, state(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def groups(df: DataFrame, key: str, text: str, members: DataFrame, links: DataFrame) -> DataFrame:
    """``(item, cls, grp)``: every item with its class of equal texts and the
    group of classes connected by links. Texts too short for a class are grouped
    if they are equal; null texts have neither. An item with several texts has a
    row for each of its classes."""
    root = components(links.select(F.col("cls_a").alias("u"), F.col("cls_b").alias("v")))
    usual = members.join(root.withColumnRenamed("node", "cls"), "cls", "left").select("item", "cls", F.coalesce("root", "cls").alias("grp"))
    exact = df.select(F.col(f"`{key}`").alias("item"), F.when(F.col(f"`{text}`").isNotNull(), F.xxhash64(F.col(f"`{text}`"))).alias("cls")).distinct()
    return usual.unionByName(exact.join(members.select("item"), "item", "left_anti").select("item", "cls", F.col("cls").alias("grp")))


def found_query(spark: SparkSession, base: str) -> DataFrame:
    members, links = near_duplicates(chunks(spark, base), "rec_id", "text", width=3, threshold=0.6, min_words=30)
    return item_pairs(members, links).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def groups_query(spark: SparkSession, base: str) -> DataFrame:
    """Documents with the class of equal texts they are in, its number of links
    and the group of classes connected by links."""
    from corvine.llm.common import documents

    d = documents(spark, base)
    members, links = near_duplicates(d, "rec_id", "text")
    n = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    g = groups(d, "rec_id", "text", members, links).join(n, "cls", "left")
    return g.select(F.col("item").cast("bigint").alias("doc_id"), F.col("cls").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.col("grp").alias("group_id"))


def chunk_groups_query(spark: SparkSession, base: str) -> DataFrame:
    """Every chunk with its class of equal texts, that class's number of links to
    other classes, and the group of chunks it is connected to by near-duplicates."""
    c = chunks(spark, base)
    members, links = near_duplicates(c, "rec_id", "text", width=3, threshold=0.6)
    n = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    g = groups(c, "rec_id", "text", members, links).join(n, "cls", "left")
    return g.select(F.col("item").alias("chunk_id"), F.col("cls").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.col("grp").alias("group_id")).distinct()

"""Problem 5: cutting oversized items at natural boundaries.

Every text is worked on by ranges. The text of a range and a halo on either side
are enough to find the boundaries in it and its anchor, a strong boundary near
its beginning; what lies between two anchors is cut by itself. Of a giant file
each worker reads byte ranges only; the ranges' numbers of pieces are brought
together as a small table whose prefix sums number the pieces of the whole file.
Pieces leave as offsets, text is never shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.llm.common import cut_batches, documents, materialize, records, shared_dir

CHARS_PER_TOKEN = 4
PARAGRAPH, LINE, SENTENCE, SPACE = 4, 3, 2, 1

_BREAKS = re.compile(r"(?P<p>\n[^\S\n]*\n\s*)|(?P<l>\n)|(?P<s>(?:[.!?…]+[\"'»”’)\]]*(?=\s)|[。！？।]+[」』”）]*)[^\S\n]*)|(?P<w>[^\S\n]+)")
#: Characters beside a stretch that decide what is a boundary in it.
HALO = 64
_LEVEL = {"p": PARAGRAPH, "l": LINE, "s": SENTENCE, "w": SPACE}


def boundaries(text: str, start: int, end: int, sparse: int) -> tuple[list[int], list[int]]:
    """Positions in ``[start, end)`` where a piece may end, with their levels.

    A space counts only where no stronger boundary lies within ``sparse``
    characters before it, which keeps the table small.
    """
    at: list[int] = []
    level: list[int] = []
    strong = -1
    for m in _BREAKS.finditer(text):
        e = m.end()
        if e <= start:
            continue
        if e > end:
            break
        k = _LEVEL[m.lastgroup]
        if k > SPACE:
            strong = e
        elif strong >= 0 and e - strong < sparse:
            continue
        at.append(e)
        level.append(k)
    return at, level


def cut(start: int, length: int, at: np.ndarray, level: np.ndarray, limit: int, overlap: int, last: int = PARAGRAPH) -> list[tuple[int, int, int]]:
    """Pieces ``(start, end, level of the end)`` of at most ``limit`` characters
    from ``start`` to ``length``, where the last one ends with level ``last``.

    An end is the strongest boundary in the second half of the room, the last
    of equals; without any, the room itself (level 0). The next piece begins at
    the earliest natural boundary inside the allowed overlap.
    """
    pieces = []
    while length - start > limit:
        lo, hi = np.searchsorted(at, [start + limit // 2, start + limit], side="right")
        if hi > lo:
            best = hi - 1 - int(np.argmax(level[lo:hi][::-1]))
            end, k = int(at[best]), int(level[best])
        else:
            lo = int(np.searchsorted(at, start + overlap, side="right"))
            end, k = (int(at[hi - 1]), int(level[hi - 1])) if hi > lo else (start + limit, 0)
        pieces.append((start, end, k))
        start = begin_before(end, at, level, overlap)
    pieces.append((start, length, last))
    return pieces


def begin_before(end: int, at: np.ndarray, level: np.ndarray, overlap: int) -> int:
    """Where the piece after one that ends at ``end`` begins."""
    a, b = np.searchsorted(at, [end - overlap, end], side="left")
    inside = np.flatnonzero(level[a:b] >= SENTENCE)
    return int(at[a + inside[0]]) if len(inside) else int(at[a]) if b > a else end - overlap


class Ranges:
    """A text of ``size`` characters (or bytes) in ranges that are cut one by one.

    ``read(a, b)`` gives a stretch of the text and ``find`` its boundaries; no
    call asks for more than a range and its halos.
    """

    def __init__(self, size: int, limit: int, overlap: int, width: int, read, find=boundaries):
        self.size, self.limit, self.overlap, self.width, self.read, self.find = size, limit, overlap, max(width, 4 * limit), read, find
        self.parts = max(1, -(-size // self.width))

    def _found(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Boundaries in ``[a, b)``, the same whoever asks."""
        first = max(0, a - HALO)
        text = self.read(first, min(self.size, b + HALO))
        at, level = self.find(text, a - first, b - first, self.limit // 4)
        return np.asarray(at, dtype=np.int64) + first, np.asarray(level, dtype=np.int8)

    def anchor(self, part: int) -> tuple[int, int]:
        """Where a range begins, and how strong that boundary is: the first of
        the strongest in its first half a piece, else the first character."""
        if part == 0 or part >= self.parts:
            return (0 if part == 0 else self.size), PARAGRAPH
        at, level = self._found(part * self.width, part * self.width + self.limit // 2)
        if not len(at):
            return part * self.width, 0
        best = int(np.argmax(level))
        return int(at[best]), int(level[best])

    def pieces(self, part: int) -> list[tuple[int, int, int]]:
        """The pieces between a range's anchor and the next one's."""
        (first, _), (end, last) = self.anchor(part), self.anchor(part + 1)
        at, level = self._found(max(0, first - self.overlap - 1), end)
        begin = begin_before(first, at, level, self.overlap) if part else 0
        return cut(begin, end, at, level, self.limit, self.overlap, last)


def _limits(max_tokens: int, overlap_tokens: int) -> tuple[int, int]:
    return (max_tokens + 1) * CHARS_PER_TOKEN - 1, overlap_tokens * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1


def split_oversized(df: DataFrame, key: list[str], text: str, max_tokens: int = 450, overlap_tokens: int = 80, range_chars: int = 1 << 16) -> DataFrame:
    """Pieces of every item of more than ``max_tokens``.

    A token is counted as four characters. Returns ``(*key, piece_no, start_pos,
    end_pos, n_tokens, cut_level)``, positions in code points from 0. Items
    within the limit, null and empty texts give no row; repeated rows count
    once; two different texts under one key are cut separately, each with its
    own run of piece numbers. Further columns are ignored, whatever their names.
    """
    limit, overlap = _limits(max_tokens, overlap_tokens)
    names = [f"k{i}" for i in range(len(key))]
    big = (
        df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(key, names)], F.col(f"`{text}`").alias("body"))
        .filter(F.floor(F.char_length("body") / CHARS_PER_TOKEN) > max_tokens)
        .withColumn("mark", F.xxhash64("body"))
    )
    kinds = dict(big.dtypes)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, "body"):
            index, rows = [], []
            for i, body in enumerate(batch.column("body").to_pylist()):
                ranges = Ranges(len(body), limit, overlap, range_chars, lambda a, b, body=body: body[a:b])
                found = [p for part in range(ranges.parts) for p in ranges.pieces(part)]
                index += [i] * len(found)
                rows += [(k, *p) for k, p in enumerate(found, 1)]
            at = pa.array(index, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in (*names, "mark")), *(pa.array([r[i] for r in rows], pa.int32()) for i in range(4))], names=[*names, "mark", "piece_no", "start_pos", "end_pos", "cut_level"])

    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "mark bigint, piece_no int, start_pos int, end_pos int, cut_level int"])
    pieces = big.mapInArrow(emit, schema).distinct()
    tokens = F.floor((F.col("end_pos") - F.col("start_pos")) / CHARS_PER_TOKEN).cast("int").alias("n_tokens")
    return pieces.select(*[F.col(n).alias(k) for k, n in zip(key, names)], "piece_no", "start_pos", "end_pos", tokens, "cut_level")


def split_files(spark: SparkSession, paths: list[str], max_tokens: int = 450, overlap_tokens: int = 80, range_bytes: int = 8 << 20) -> DataFrame:
    """``split_oversized`` for UTF-8 files too large for one row: workers read
    byte ranges of the files by themselves.

    Returns ``(path, piece_no, start_pos, end_pos, cut_level)`` in bytes. Each
    piece has at most ``4 * max_tokens + 3`` bytes, hence no more characters, and
    no character is cut. An empty file gives no row. ``paths`` are files or
    folders; they are opened through Arrow's file systems (local, HDFS, S3, GCS).
    Of each range only its number of pieces is brought together with others.
    """
    limit, overlap = _limits(max_tokens, overlap_tokens)
    width = max(range_bytes, 4 * limit)
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size")).filter("size > 0")
    ranges = files.select("path", "size", F.explode(F.expr(f"sequence(0, (size - 1) div {width})")).alias("part"))
    ranges = ranges.repartition(max(1, spark.sparkContext.defaultParallelism), "path", "part")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, size, part in zip(*(batch.column(n).to_pylist() for n in ("path", "size", "part"))):
                system, inner = fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
                with system.open_input_file(inner) as f:
                    # One character a byte, so that positions are bytes.
                    found = Ranges(size, limit, overlap, width, lambda a, b, f=f: f.read_at(b - a, a).decode("latin-1"), _byte_boundaries).pieces(part)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array([part] * len(found), pa.int64()), pa.array(range(1, len(found) + 1), pa.int64()), *(pa.array([p[i] for p in found], pa.int64()) for i in range(3))], names=["path", "part", "no", "start_pos", "end_pos", "cut_level"])

    pieces = materialize(ranges.mapInArrow(emit, "path string, part bigint, no bigint, start_pos bigint, end_pos bigint, cut_level bigint"), "pieces")
    before = F.sum("n").over(W.partitionBy("path").orderBy("part")) - F.col("n")
    sums = pieces.groupBy("path", "part").agg(F.count("*").alias("n")).select("path", "part", before.alias("before"))
    return pieces.join(sums, ["path", "part"]).select("path", (F.col("before") + F.col("no")).alias("piece_no"), "start_pos", "end_pos", F.col("cut_level").cast("int").alias("cut_level"))


def _utf8(*signs: str) -> str:
    """Any of some signs, as the bytes of their UTF-8 form."""
    return "(?:" + "|".join(x.encode().decode("latin-1") for x in signs) + ")"


_BYTE_BREAKS = re.compile(
    r"(?P<p>\n[ \t\r]*\n[ \t\r\n]*)|(?P<l>\n)"
    rf"|(?P<s>(?:(?:[.!?]|{_utf8('…')})+(?:[\"')\]]|{_utf8('»', '”', '’')})*(?=[ \t\r\n])|{_utf8('。', '！', '？', '।')}+{_utf8('」', '』', '”', '）')}*)[ \t\r]*)|(?P<w>[ \t\r]+)"
)


def _byte_boundaries(text: str, start: int, end: int, sparse: int) -> tuple[list[int], list[int]]:
    """As ``boundaries`` over bytes; where neither mark nor space comes for
    ``sparse`` bytes, the first byte of a character counts at level 0."""
    at: list[int] = []
    level: list[int] = []
    last = start

    def fill(until: int) -> None:
        nonlocal last
        while until - last > sparse:
            last += sparse // 2
            while last < until and 0x80 <= ord(text[last]) < 0xC0:
                last += 1
            at.append(last)
            level.append(0)

    for m in _BYTE_BREAKS.finditer(text):
        e = m.end()
        if e <= start:
            continue
        if e > end:
            break
        fill(e)
        if at and at[-1] == e:
            level[-1] = _LEVEL[m.lastgroup]
        else:
            at.append(e)
            level.append(_LEVEL[m.lastgroup])
        last = e
    fill(min(end, len(text)))
    return at, level


def pieces_query(spark: SparkSession, base: str) -> DataFrame:
    return split_oversized(records(spark, base), ["src", "rec_id"], "text")


def found_query(spark: SparkSession, base: str) -> DataFrame:
    """An item was oversized exactly if it came out in two pieces or more."""
    return pieces_query(spark, base).filter("piece_no = 2").select("src", "rec_id").distinct()


def files_query(spark: SparkSession, base: str) -> DataFrame:
    """Pieces of a few large files that hold the texts of all documents."""
    d = documents(spark, base).filter("text is not null").select(F.col("rec_id").cast("bigint").alias("n"), "text")
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    cores = spark.sparkContext.defaultParallelism
    d.repartitionByRange(cores, "n").sortWithinPartitions("n").select(F.concat("text", F.lit("\n")).alias("value")).write.text(path)
    return split_files(spark, [path], range_bytes=1 << 20).select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file_no"), "piece_no", "start_pos", "end_pos", "cut_level")

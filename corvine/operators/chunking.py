"""Cutting documents into chunks. Packing is sequential within a document and runs
in Arrow batches of whole documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_HEADING = re.compile(r"^(#{1,3})[ \t]+(.+?)[ \t]*$", re.M)
SIZE, OVERLAP, LEAST = 450, 80, 100


def tokens(text: str) -> int:
    return len(text) // 4


def by_sentences(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Whole sentences packed up to ``size`` tokens, each chunk opening with the
    last sentences of the one before as far as ``overlap`` allows. Chunks below
    ``least`` go unless nothing else is left."""
    out: list[str] = []
    now: list[str] = []
    fresh = False
    for p in re.split(r"\n\s*\n", text):
        for s in filter(None, (x.strip() for x in _SENTENCE.split(p))):
            if now and tokens(" ".join([*now, s])) > size:
                if fresh:
                    out.append(" ".join(now))
                tail: list[str] = []
                for x in reversed(now):
                    if tokens(" ".join([x, *tail])) > overlap:
                        break
                    tail.insert(0, x)
                now = tail if tokens(" ".join([*tail, s])) <= size else []
            now.append(s)
            fresh = True
    if now and fresh:
        out.append(" ".join(now))
    big = [c for c in out if tokens(c) >= least]
    return big or out[:1]


def recursive(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """The coarsest separator that makes pieces fit, finer ones for pieces that don't."""

    def pieces(t: str, seps: tuple[str, ...]) -> list[str]:
        if tokens(t) <= size or not seps:
            return [t]
        if seps[0] == "":
            return [t[i : i + 4 * size] for i in range(0, len(t), 4 * size)]
        if seps[0] not in t:
            return pieces(t, seps[1:])
        parts = t.split(seps[0])
        return [y for i, x in enumerate(parts) for y in pieces(x + (seps[0] if i + 1 < len(parts) else ""), seps[1:])]

    out: list[str] = []
    now: list[str] = []
    for p in pieces(text, separators):
        if now and tokens("".join(now) + p) > size:
            out.append("".join(now).strip())
            while now and (tokens("".join(now)) > overlap or tokens("".join(now) + p) > size):
                now.pop(0)
        now.append(p)
    if "".join(now).strip():
        out.append("".join(now).strip())
    return [c for c in out if tokens(c) >= least] or [c for c in out if c][:1]


def by_headings(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[str, dict[str, str]]]:
    """Sections under Markdown headings of the first three levels with the
    headings above them; sections too large are cut further."""
    out: list[tuple[str, dict[str, str]]] = []
    path: dict[int, str] = {}
    marks = list(_HEADING.finditer(text))
    bounds = [(0, marks[0].start() if marks else len(text), None), *((m.end(), n.start() if n else len(text), m) for m, n in zip(marks, [*marks[1:], None]))]
    for a, b, m in bounds:
        if m:
            level = len(m.group(1))
            path = {k: v for k, v in path.items() if k < level} | {level: m.group(2)}
        body = text[a:b].strip()
        if body:
            above = {f"Header {k}": v for k, v in sorted(path.items())}
            out += [(c, above) for c in ([body] if tokens(body) <= size else recursive(body, size, overlap, least))]
    return out


def strategy(filename, text):
    """Which chunker a document takes, as a column."""
    heads = text.rlike(r"(?m)^#+\s")
    return F.when(F.lower(filename).rlike(r"\.(md|markdown)$") & heads, "markdown").when(F.lower(filename).rlike(r"\.(py|js|ts|java|go|rs|c|cpp|h)$"), "recursive").otherwise("semantic")


#: Ways to cut a text by name, ``(text, size, overlap, least) -> [(chunk, headings)]``; add one to have it used.
CHUNKERS = {
    "semantic": lambda t, *a: [(c, {}) for c in by_sentences(t, *a)],
    "recursive": lambda t, *a: [(c, {}) for c in recursive(t, *a)],
    "markdown": lambda t, *a: by_headings(t, *a),
}


def chunk_documents(df: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, way: str | None = None) -> DataFrame:
    """``(filename, strategy, chunk_index, total_chunks, content, n_tokens,
    headings)`` of ``(filename, text)``; ``headings`` maps 'Header 1' to 'Header
    3' to the headings above a chunk. Null and blank texts give no chunk. ``way``
    is one of ``CHUNKERS``, else it follows the file."""
    kind = F.lit(way) if way else strategy(F.col("filename"), F.col("text"))
    d = df.select("filename", "text", kind.alias("strategy")).filter("trim(text) <> ''")
    ways = dict(CHUNKERS)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, t, s in zip(b["filename"], b["text"], b["strategy"]):
                c = ways[s](t, size, overlap, least)
                rows += [(f, s, i, len(c), x, tokens(x), h) for i, (x, h) in enumerate(c)]
            yield pd.DataFrame(rows, columns=["filename", "strategy", "chunk_index", "total_chunks", "content", "n_tokens", "headings"])

    return d.mapInPandas(cut, "filename string, strategy string, chunk_index int, total_chunks int, content string, n_tokens int, headings map<string,string>")


def parents(df: DataFrame, size: int = 2048, overlap: int = 512) -> DataFrame:
    """Parents of successive chunks of a document up to ``size`` tokens, each
    opening with the last chunks of the one before as far as ``overlap`` allows:
    ``(filename, parent_no, first_index, last_index, n_tokens)``. A chunk larger
    than ``size`` is a parent alone. A document's chunks are one group; only
    their sizes are moved."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("chunk_index")
        index, n = g["chunk_index"].to_numpy(), g["n_tokens"].to_numpy()
        out, a = [], 0
        while a < len(n):
            b, total = a, 0
            while b < len(n) and (b == a or total + n[b] <= size):
                total += n[b]
                b += 1
            out.append((index[a], index[b - 1], total))
            if b == len(n):
                break
            back, held = b, 0
            while back - 1 > a and held + n[back - 1] <= overlap and held + n[back - 1] + n[b] <= size:
                back -= 1
                held += n[back]
            a = back
        return pd.DataFrame([(g["filename"].iloc[0], k, *x) for k, x in enumerate(out)], columns=["filename", "parent_no", "first_index", "last_index", "n_tokens"])

    return df.select("filename", "chunk_index", "n_tokens").groupBy("filename").applyInPandas(one, "filename string, parent_no int, first_index int, last_index int, n_tokens int")


def children(parents: DataFrame) -> DataFrame:
    """``(filename, chunk_index, parent_no)``: of the parents a chunk is in, the last."""
    each = parents.select("filename", "parent_no", F.explode(F.sequence("first_index", "last_index")).alias("chunk_index"))
    return each.groupBy("filename", "chunk_index").agg(F.max("parent_no").alias("parent_no"))


def contextual(title, section, content, summary=None, headings=None):
    """A chunk's text behind the document's title and summary and the section it
    is in, for embedding; without ``section`` the path of its ``headings``."""
    path = F.concat_ws(" > ", *[F.try_element_at(headings, F.lit(f"Header {k}")) for k in (1, 2, 3)]) if headings is not None else F.lit("")
    section = F.coalesce(section, F.nullif(path, F.lit("")))
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c, F.lit(".")))
    head = F.concat_ws(" ", part("Document", title), part("Context", F.rtrim(summary, F.lit("."))) if summary is not None else F.lit(None), part("Section", section))
    return F.when(head != "", F.concat(head, F.lit("\n\n"), content)).otherwise(content)

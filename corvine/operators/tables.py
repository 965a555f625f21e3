"""Tables inside texts: where they are, cut by rows with their headers, and chunks
that leave them whole."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from corvine.operators.chunking import LEAST, OVERLAP, SIZE, by_sentences, tokens

_RULE = re.compile(r"\|[\s\-:]+\|[\s\-:|]+$")
_HTML = re.compile(r"<table[^>]*>.*?</table>", re.S | re.I)
_GAP = re.compile(r"\S(?:\s{2,}|\t)\S")
#: Confidence of aligned text, which other kinds of tables win over.
ALIGNED = 0.7


def _pipe_regions(lines: list[tuple[int, str]]) -> Iterator[tuple]:
    run: list[tuple[int, str]] = []
    for at, x in [*lines, (-1, "")]:
        if x.count("|") >= (1 if run else 2):
            run.append((at, x))
            continue
        if len(run) >= 2:
            rule = next((k for k, (_, y) in enumerate(run) if k and _RULE.match(y.strip())), None)
            headers = [c.strip() for c in run[rule - 1][1].strip().strip("|").split("|")] if rule else []
            yield run[0][0], run[-1][0] + len(run[-1][1]), "markdown", 1.0, headers
        run = []


def _aligned_regions(lines: list[tuple[int, str]]) -> Iterator[tuple]:
    run: list[tuple[int, str]] = []
    for at, x in [*lines, (-1, "")]:
        if at >= 0 and _GAP.search(x) and (run or len(x.strip()) > 20):
            run.append((at, x))
            continue
        if len(run) >= 3:
            yield run[0][0], run[-1][0] + len(run[-1][1]), "plain_text", ALIGNED, []
        run = []


def regions(text: str) -> list[tuple[int, int, str, float, list[str]]]:
    """``(start, end, kind, confidence, headers)`` of the tables of a text, in
    order and without overlap: of two that overlap the surer, else the first."""
    lines, at = [], 0
    for x in text.split("\n"):
        lines.append((at, x))
        at += len(x) + 1
    found = [*_pipe_regions(lines), *_aligned_regions(lines)]
    for m in _HTML.finditer(text):
        heads = [re.sub(r"<[^>]+>", "", h).strip() for h in re.findall(r"<th[^>]*>(.*?)</th>", m.group(), re.S | re.I)]
        found.append((m.start(), m.end(), "html", 1.0, heads))
    out: list[tuple] = []
    for r in sorted(found, key=lambda r: (-r[3], r[0])):
        if all(r[1] <= o[0] or r[0] >= o[1] for o in out):
            out.append(r)
    return sorted(out)


def split_rows(table: str, kind: str, size: int) -> list[str]:
    """A table in parts of at most ``size`` tokens, each with its header rows. A
    row larger than that is a part alone."""
    if tokens(table) <= size:
        return [table]
    rows = table.split("\n")
    if kind == "html":
        head = re.search(r"<thead[^>]*>.*?</thead>", table, re.S | re.I)
        body = re.findall(r"<tr[^>]*>.*?</tr>", table[head.end() :] if head else table, re.S | re.I)
        start, rows, end = "<table>" + (head.group() if head else "") + "\n", body, "\n</table>"
    else:
        n = 2 if kind == "markdown" and len(rows) > 1 else 1
        start, rows, end = "\n".join(rows[:n]) + "\n", rows[n:], ""
    out: list[str] = []
    now: list[str] = []
    for row in rows:
        if now and tokens(start + "\n".join([*now, row]) + end) > size:
            out.append(start + "\n".join(now) + end)
            now = []
        now.append(row)
    return [*out, start + "\n".join(now) + end] if now else out


def detect(df: DataFrame) -> DataFrame:
    """``(filename, table_no, start_pos, end_pos, kind, confidence, headers)`` of
    ``(filename, text)``; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, k, *r) for f, t in zip(b["filename"], b["text"]) if t for k, r in enumerate(regions(t))]
            yield pd.DataFrame(rows, columns=["filename", "table_no", "start_pos", "end_pos", "kind", "confidence", "headers"])

    return df.select("filename", "text").mapInPandas(run, "filename string, table_no int, start_pos int, end_pos int, kind string, confidence double, headers array<string>")


def chunk_with_tables(df: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, table_size: int = 1000) -> DataFrame:
    """``(filename, chunk_index, total_chunks, content, n_tokens, is_table, kind,
    headers)``: the text between tables cut by sentences, tables whole or cut by
    rows. Chunks are numbered in order over the whole document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, t in zip(b["filename"], b["text"]):
                if not t or not t.strip():
                    continue
                parts: list[tuple] = []
                at = 0
                for start, end, kind, _, headers in [*regions(t), (len(t), len(t), "", 0, [])]:
                    parts += [(c, False, None, []) for c in by_sentences(t[at:start], size, overlap, least)]
                    if kind:
                        parts += [(c, True, kind, headers) for c in split_rows(t[start:end], kind, table_size)]
                    at = end
                rows += [(f, i, len(parts), c, tokens(c), *rest) for i, (c, *rest) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["filename", "chunk_index", "total_chunks", "content", "n_tokens", "is_table", "kind", "headers"])

    return df.select("filename", "text").mapInPandas(run, "filename string, chunk_index int, total_chunks int, content string, n_tokens int, is_table boolean, kind string, headers array<string>")

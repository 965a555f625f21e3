"""Documents out of files: Markdown, delimited tables, HTML and plain text."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parsers of further kinds by extension, ``bytes -> text``; a PDF parser goes here where a library is at hand.
PARSERS: dict[str, Callable[[bytes], str]] = {}


class _Page(HTMLParser):
    """A page's headings, paragraphs and items; scripts, styles, navigation and footers are dropped."""

    dropped = {"script", "style", "nav", "footer", "iframe"}

    def __init__(self):
        super().__init__()
        self.lines: list[str] = []
        self.now: list[str] = []
        self.prefix, self.deep = "", 0

    def _flush(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.lines.append(self.prefix + text)
        self.now, self.prefix = [], ""

    def handle_starttag(self, tag, attrs):
        if tag in self.dropped:
            self.deep += 1
        elif tag in ("h1", "h2", "h3", "title"):
            self._flush()
            self.prefix = "# " if tag == "title" else "#" * int(tag[1]) + " "
        elif tag in ("p", "div", "li"):
            self._flush()
            self.prefix = "- " if tag == "li" else ""

    def handle_endtag(self, tag):
        if tag in self.dropped:
            self.deep = max(0, self.deep - 1)
        elif tag in ("h1", "h2", "h3", "title", "p", "div", "li", "body"):
            self._flush()

    def handle_data(self, data):
        if not self.deep:
            self.now.append(data)


def html_text(raw: str) -> str:
    p = _Page()
    p.feed(raw)
    p.close()
    p._flush()
    return "\n\n".join(p.lines)


def table_text(raw: str, delimiter: str = ",") -> str:
    """A delimited table as a Markdown pipe table."""
    rows = list(csv.reader(io.StringIO(raw), delimiter=delimiter))
    if not rows:
        return ""
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), "|" + "---|" * len(rows[0]), *map(line, rows[1:])])


class UnknownKind(ValueError):
    """No parser for a file's extension."""


def parse(raw: bytes | None, extension: str) -> tuple[str | None, dict[str, str]]:
    """Text and metadata of a file's bytes. Raises ``UnknownKind`` for an extension
    without a parser and ``ValueError`` for an empty Markdown file."""
    if raw is None:
        return None, {}
    if extension in PARSERS:
        text = PARSERS[extension](raw)
        return text, {"char_count": str(len(text))}
    text = raw.decode("utf-8", errors="replace")
    if extension in ("md", "markdown"):
        if not text.strip():
            raise ValueError("empty file")
        heads = re.findall(r"^(#{1,6})[ \t]+(.+?)[ \t]*$", text, re.M)
        title = next((h for n, h in heads if len(n) <= 2), None)
        return text, {"char_count": str(len(text)), "headings": str(len(heads))} | ({"title": title} if title else {})
    if extension == "txt":
        return text, {"char_count": str(len(text))}
    if extension in ("csv", "tsv"):
        sign = "\t" if extension == "tsv" else ","
        rows = list(csv.reader(io.StringIO(text), delimiter=sign))
        return table_text(text, sign), {"rows": str(max(0, len(rows) - 1)), "columns": ", ".join(rows[0]) if rows else ""}
    if extension in ("html", "htm"):
        page = html_text(text)
        return page, {"char_count": str(len(page))} | ({"title": page.split("\n")[0][2:]} if page.startswith("# ") else {})
    raise UnknownKind(f"no parser for .{extension}")


def parse_frame(files: DataFrame, failing: str = "error") -> DataFrame:
    """``(filename, extension, text, metadata, error)`` of ``(filename, content
    BINARY)``. A file that can't be read has null text and says why in ``error``;
    with ``failing='raise'`` it ends the job, with ``'skip'`` it has no row."""
    parsers = dict(PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        PARSERS.update(parsers)
        for b in batches:
            rows = []
            for f, c in zip(b["filename"], b["content"]):
                ext = str(f).rsplit(".", 1)[-1].lower() if f and "." in str(f) else ""
                try:
                    rows.append((f, ext, *parse(c, ext), None))
                except Exception as e:
                    if failing == "raise":
                        raise
                    if failing == "error":
                        rows.append((f, ext, None, {}, str(e)))
            yield pd.DataFrame(rows, columns=["filename", "extension", "text", "metadata", "error"])

    return files.select("filename", "content").mapInPandas(run, "filename string, extension string, text string, metadata map<string,string>, error string")


def read_directory(spark: SparkSession, path: str, recursive: bool = True, pattern: str = "*") -> DataFrame:
    """Every file below a folder, parsed; unreadable files are skipped."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true").load(path)
    return parse_frame(f.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content"), "skip")


def read_buffer(spark: SparkSession, files: list[tuple[str, bytes]]) -> DataFrame:
    """Files given as bytes, parsed."""
    return parse_frame(spark.createDataFrame([(n, bytearray(c)) for n, c in files], "filename string, content binary"))


def headings(text):
    """Headings of a Markdown text as an array of ``{level, text}``."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6}\s+.*)$"), 1), lambda h: F.struct(F.length(F.regexp_extract(h, r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(h, r"^#+\s+", "")).alias("text")))

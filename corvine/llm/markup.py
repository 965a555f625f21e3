"""Problem 6: markup residue in texts.

Code and formulas are set aside first, since signs inside them mean nothing.
What holds tags then streams through the standard library's HTML parser, whose
events open and close headings, items and paragraphs; the ratio of text to tags
per line, smoothed by a Gaussian and split into two clusters, tells the regions of
content from the tag-heavy ones around them, whose lines of mere links (menus,
breadcrumbs, link lists) are left out. Blocks between blank lines are read
as Markdown, wiki or LaTeX structure, and inline markup is taken off what is left.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corvine.llm.common import cut_batches, records

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"

_ANY = re.compile(
    r"</?[A-Za-z!]|&(?:[A-Za-z]{2,8}|#\d+);|\\[A-Za-z(\[_#$%&{}]|\*\*|__|~~|`|\[\[|\{\{|''|\]\(|\$[A-Za-z\\$]|(?<![\w*])\*\w"
    r"|^[ ]{0,3}(?:[#=|>*+\-]|\d+[.)] )",
    re.M,
)
_ASIDE = re.compile(
    r"^(?P<f>```|~~~)[^\n`]*\n(?P<fence>.*?)(?:\n(?P=f)[ \t]*$|\Z)"
    r"|<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(?P<pre>.*?)(?:</code>\s*)?</pre>"
    r"|<(?P<s>syntaxhighlight|source)\b[^>]*>(?P<high>.*?)</(?P=s)>"
    r"|\\begin\{(?P<v>verbatim\*?|lstlisting)\}(?P<verb>.*?)\\end\{(?P=v)\}"
    r"|\\begin\{(?P<e>(?:equation|align|gather|displaymath|eqnarray)\*?)\}(?P<env>.*?)\\end\{(?P=e)\}"
    r"|<math\b[^>]*>(?P<math>.*?)</math>"
    r"|\$\$(?P<two>.+?)\$\$|\\\[(?P<square>.+?)\\\]|\\\((?P<round>.+?)\\\)"
    r"|(?<![\\$\w])\$(?=[A-Za-z\\({])(?P<one>(?:[^$\n]|\n(?!\s*\n))+?)(?<![\\\s])\$(?![\w$])",
    re.S | re.M | re.I,
)
_CODE = {"fence": MARKDOWN, "pre": HTML, "high": WIKI, "verb": LATEX}
_FORMULA = {"env": LATEX, "square": LATEX, "round": LATEX, "two": MARKDOWN, "math": "", "one": ""}

_TAG = re.compile(r"</?(?:p|div|h[1-6]|ul|ol|li|dl|dt|dd|b|i|u|em|strong|span|a|br|hr|code|nav|table|t[rdh]|thead|tbody|script|style|img|blockquote|section|article|header|footer|main|body|html|head|title|sup|sub|small|font|center)\b[^<>]*>|<!--", re.I)
_LINK = re.compile(r"<a\b[^<>]*>(.*?)</a>", re.I)
_ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}|#\d+|#x[0-9a-fA-F]+);")
_WIKI = re.compile(r"'''?[^'\n]+'''?|\[\[[^\[\]\n]+\]\]|\{\{[^{}\n]+\}\}|<ref\b|^(={2,6})[^=\n].*?\1[ \t]*$", re.M | re.I)
_LATEX = re.compile(r"\\(?:(?:sub)*section|chapter|paragraph|begin|end|textbf|textit|emph|texttt|underline|cite|footnote|item|label|ref)\b|\\[_#$%&{}]|^%[ \t]", re.M)
_MD = re.compile(r"\*\*[^*\n]+\*\*|(?<!\w)__[^_\n]+__(?!\w)|~~[^~\n]+~~|`[^`\n]+`|!?\[[^\]\n]*\]\([^)\s]*\)|^#{2,6}[ \t]+\S|^> |(?<![\w*])\*(?=\w)[^*\n]+(?<=\w)\*(?![\w*])", re.M)
_BACKSLASH = re.compile(r"\\[_*#\[\]()`~>+!.\-]")

_OPEN, _SHUT = "\ue000", "\ue001"  # around the number of something set aside
_HEAD, _ITEM = "\ue002", "\ue003"  # in front of a heading or an item of the HTML events
_ASIDE_REF = re.compile(f"{_OPEN}(\\d+){_SHUT}")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_PAGE = re.compile(r"[-–—]\s?\w{1,4}\s?[-–—]\s*$")
_SECTION = re.compile(r"\\(?:(?:sub)*section|chapter)\*?\{((?:[^{}]|\{[^{}]*\})*)\}(?:[ \t]*\\label\{[^{}]*\})?")
_LIST = re.compile(r"[ \t]{0,6}(?:([-*+•])|(\d{1,3})[.)]|([*#]+|[:;]))[ \t]+(?=\S)")
_ATX = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_WHEAD = re.compile(r"(={1,6})[ \t]*([^=].*?)[ \t]*\1[ \t]*$")
_RULE = re.compile(r"(?:={3,}|-{3,})[ \t]*$")
_PIPE = re.compile(r"[ \t]*\|.*\|[ \t]*$")
_ITEMS = re.compile(r"\\begin\{(?:itemize|enumerate|description)\}(?:\[[^\]]*\])?|\\end\{(?:itemize|enumerate|description)\}")
_ENV = re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?|\\label\{[^{}]*\}|^%[^\n]*$", re.M)

#: Tags whose content is no text of the document.
_SILENT = {"script", "style", "nav", "ref", "title"}
_BLOCK = {"p", "div", "ul", "ol", "table", "tr", "section", "article", "blockquote", "header", "footer", "main", "hr", "dl"}


class _Events(HTMLParser):
    """Text with its block structure out of the parser's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent.append(tag)
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append(f"\n\n{_HEAD}")
        elif tag in ("li", "dt", "dd"):
            self.out.append(f"\n\n{_ITEM}")
        elif tag in _BLOCK:
            self.out.append("\n\n")
        elif tag in ("br", "td", "th"):
            self.out.append(" ")

    def handle_startendtag(self, tag, attrs):
        if tag not in _SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.silent:
            while self.silent.pop() != tag:
                pass
        elif tag in _BLOCK or tag in ("li", "dt", "dd") or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def content_lines(lines: list[str], width: float = 1.5) -> list[bool]:
    """Which lines are content, by their ratio of text to tags.

    The ratios are smoothed by a Gaussian over neighbouring lines and split into
    two clusters by their means; lines below the split that hold mostly tags are
    not content. Where all lines are alike there is one cluster and all are.
    """
    ratio = []
    for x in lines:
        tags = len(_TAG.findall(x))
        ratio.append(len(_TAG.sub("", x).strip()) / max(1, tags))
    n, reach = len(ratio), math.ceil(2 * width)
    kernel = [math.exp(-(d * d) / (2 * width * width)) for d in range(reach + 1)]
    smooth = []
    for i in range(n):
        total = weight = 0.0
        for d in range(-reach, reach + 1):
            if 0 <= i + d < n:
                total += ratio[i + d] * kernel[abs(d)]
                weight += kernel[abs(d)]
        smooth.append(total / weight)
    low, high = min(smooth, default=0.0), max(smooth, default=0.0)
    for _ in range(8):
        cut = (low + high) / 2
        a, b = [x for x in smooth if x <= cut], [x for x in smooth if x > cut]
        if not a or not b:
            break
        low, high = sum(a) / len(a), sum(b) / len(b)
    if high < 4 * low:
        return [True] * n
    cut = (low + high) / 2 * 0.5
    return [s > cut or r > cut for s, r in zip(smooth, ratio)]


def _linked(line: str) -> bool:
    """Whether a line holds links and hardly any text of its own, as menus do."""
    inner = sum(len(_TAG.sub("", x).split()) for x in _LINK.findall(line))
    own = len(re.findall(r"\w+", _TAG.sub("", _LINK.sub(" ", line))))
    return inner > 0 and own < inner and _OPEN not in line and not re.search(r"<h[1-6]\b", line, re.I)


class Analysis:
    """What a text holds: its markup languages, elements and blocks in order."""

    __slots__ = ("languages", "elements", "blocks")

    def __init__(self):
        self.languages: set[str] = set()
        self.elements: list[tuple[str, str]] = []
        #: (kind, body) with kind text, heading, list_item, code, formula or table.
        self.blocks: list[tuple[str, str]] = []


def _squeeze(s: str) -> str:
    return " ".join(s.split())


def analyse(text: str | None) -> Analysis:
    a = Analysis()
    if not text:
        return a
    if not _ANY.search(text):
        a.blocks = [("text", p) for p in _BLANK.split(text) if p.strip()]
        return a
    found = a.languages
    aside: list[tuple[str, str]] = []
    undecided: set[str] = set()

    def keep(m: re.Match) -> str:
        kind = next(k for k in ("fence", "pre", "high", "verb", "env", "math", "two", "square", "round", "one") if m.group(k) is not None)
        body = m.group(kind)
        if kind in _CODE:
            found.add(_CODE[kind])
            if kind == "pre":
                body = html.unescape(re.sub(r"</?(?:code|span|b|i|em|a)\b[^<>]*>", "", body))
            aside.append(("code", body))
        else:
            if _FORMULA[kind]:
                found.add(_FORMULA[kind])
            else:
                undecided.add(kind)
            aside.append(("formula", html.unescape(body) if kind == "math" else body))
        own = kind in ("fence", "pre", "high", "verb", "env", "two", "square")
        mark = f"{_OPEN}{len(aside) - 1}{_SHUT}"
        return f"\n\n{mark}\n\n" if own and "\n\n" in text[max(0, m.start() - 2) : m.end() + 2] + "\n\n" and (m.start() == 0 or text[m.start() - 1] == "\n") else mark

    t = _ASIDE.sub(keep, text)
    if _TAG.search(t) or "<ref" in t or "<nowiki" in t:
        if _TAG.search(t):
            found.add(HTML)
            lines = t.split("\n")
            t = "\n".join(x for x, ok in zip(lines, content_lines(lines)) if ok or not _linked(x))
        if "<ref" in t:
            found.add(WIKI)
        if _ENTITY.search(t):
            found.add(HTML)
        e = _Events()
        e.feed(t)
        e.close()
        t = "".join(e.out)
    elif _ENTITY.search(t):
        found.add(HTML)
        t = html.unescape(t)
    if _WIKI.search(t):
        found.add(WIKI)
    if _LATEX.search(t):
        found.add(LATEX)
    elif _BACKSLASH.search(t):
        found.add(MARKDOWN)
    if _MD.search(t):
        found.add(MARKDOWN)
    if "one" in undecided:
        found.add(LATEX if LATEX in found and MARKDOWN not in found else MARKDOWN)
    if "math" in undecided:
        found.add(WIKI if WIKI in found and HTML not in found else HTML)
    for block in _BLANK.split(t):
        if block.strip():
            _block(a, block, aside)
    return a


def _put(a: Analysis, kind: str, body: str, aside: list[tuple[str, str]]) -> None:
    """Add a block, giving back what was set aside in it."""
    if kind == "text" and "\\" in body:
        body = _ENV.sub(" ", body)
    clean = inline(body, a.languages)
    inner = [aside[int(i)] for i in _ASIDE_REF.findall(clean)]
    for k, x in inner:
        a.elements.append((k, _squeeze(x)))
    bare = _ASIDE_REF.sub("", clean).strip()
    if kind == "text" and not bare and inner:
        a.blocks += inner
        return
    if not bare:
        return
    clean = _ASIDE_REF.sub(lambda m: aside[int(m.group(1))][1], clean)
    if kind != "text":
        clean = _squeeze(clean)
        a.elements.append((kind, clean))
    a.blocks.append((kind, clean.strip()))


def _block(a: Analysis, block: str, aside: list[tuple[str, str]]) -> None:
    found = a.languages
    block = block.strip("\n")
    head = block.lstrip()
    if head.startswith(_HEAD):
        return _put(a, "heading", head[1:], aside)
    if head.startswith(_ITEM):
        return _put(a, "list_item", head[1:], aside)
    lines = block.split("\n")
    if LATEX in found and "\\" in block:
        if m := _SECTION.match(head):
            _put(a, "heading", m.group(1), aside)
            rest = head[m.end() :].strip()
            return _block(a, rest, aside) if rest else None
        if "\\item" in block:
            before, *items = re.split(r"\\item\b(?:\[[^\]]*\])?", block)
            before = _ITEMS.sub("", before).strip()
            if before:
                _put(a, "text", before, aside)
            for x in items:
                end = re.search(r"\\end\{", x)
                _put(a, "list_item", x[: end.start()] if end else x, aside)
                if end and (rest := _ITEMS.sub("", x[end.start() :]).strip()):
                    _put(a, "text", rest, aside)
            return None
    if len(lines) == 2 and _RULE.match(lines[1]) and lines[0].strip() and not _PIPE.match(lines[0]) and abs(len(lines[1].strip()) - len(lines[0].strip())) <= 40:
        found.add(MARKDOWN)
        return _put(a, "heading", lines[0], aside)
    if all(_PIPE.match(x) for x in lines):
        found.add(MARKDOWN)
        a.blocks.append(("table", block))
        for x in lines:
            for k, y in (aside[int(i)] for i in _ASIDE_REF.findall(x)):
                a.elements.append((k, _squeeze(y)))
        return None
    marks = [_LIST.match(x) for x in lines]
    if all(marks) and not _PAGE.match(lines[0].strip()):
        signs = [m.group(1) or ("9" if m.group(2) else m.group(3)) for m in marks]
        numbered = signs[0] == "9"
        single = len(lines) == 1
        if signs[0][0] == "#":
            if len(set(map(len, signs))) == 1 and len(signs[0]) == 1 and (not single or WIKI in found and MARKDOWN not in found):
                found.add(WIKI)
                for x, m in zip(lines, marks):
                    _put(a, "list_item", x[m.end() :], aside)
                return None
        elif signs[0] not in ":;" and not (numbered and single and marks[0].group(2) != "1"):
            if set(signs) == {"*"} and WIKI in found and MARKDOWN not in found:
                pass
            else:
                found.add(MARKDOWN)
            for x, m in zip(lines, marks):
                _put(a, "list_item", x[m.end() :], aside)
            return None
    text: list[str] = []

    def flush() -> None:
        if text:
            _put(a, "text", "\n".join(text), aside)
            text.clear()

    for i, x in enumerate(lines):
        if x[:1] == "=" and (m := _WHEAD.match(x)):
            flush()
            found.add(WIKI)
            _put(a, "heading", m.group(2), aside)
        elif x.lstrip()[:1] == "#" and (m := _ATX.match(x)) and m.group(2):
            flush()
            found.add(MARKDOWN)
            _put(a, "heading", m.group(2), aside)
        elif x.startswith("\\") and (m := _SECTION.match(x)):
            flush()
            _put(a, "heading", m.group(1), aside)
            if x[m.end() :].strip():
                text.append(x[m.end() :])
        elif x.startswith("> ") or x == ">":
            found.add(MARKDOWN)
            text.append(x[2:])
        else:
            text.append(x)
    flush()
    return None


_INLINE = re.compile(r"[*_~`\[{'\\]")
_STEPS_WIKI = ((re.compile(r"\{\{[^{}]*\}\}"), ""), (re.compile(r"\[\[(?:[^|\[\]]*\|)?([^\[\]]*)\]\]"), r"\1"), (re.compile(r"'''''|'''|''"), ""))
_STEPS_MD = (
    (re.compile(r"!\[[^\]]*\]\([^)\s]*\)"), ""),
    (re.compile(r"\[([^\]\n]*)\]\([^)\s]*\)"), r"\1"),
    (re.compile(r"\*\*([^*\n]+(?:\n[^*\n]+)?)\*\*"), r"\1"),
    (re.compile(r"(?<!\w)__([^_\n]+)__(?!\w)"), r"\1"),
    (re.compile(r"~~([^~]+)~~"), r"\1"),
    (re.compile(r"(`+)([^`]+)\1"), r"\2"),
    (re.compile(r"(?<![\w*])\*(?=\w)([^*\n]+)(?<=\w)\*(?![\w*])"), r"\1"),
    (re.compile(r"(?<!\w)_(?=[^\W_])([^_\n]+)(?<=[^\W_])_(?!\w)"), r"\1"),
)
_STEPS_TEX = (
    (re.compile(r"~?\\(?:cite\w*|ref|eqref|label)(?:\[[^\]]*\])?\{[^{}]*\}"), ""),
    (re.compile(r"\\footnote\{(?:[^{}]|\{[^{}]*\})*\}"), ""),
    (re.compile(r"\\(?:textbf|textit|emph|texttt|underline|textsc|mbox)\{([^{}]*)\}"), r"\1"),
    (re.compile(r"(?<=\S)~(?=\S)"), " "),
)
_ESCAPED = re.compile(r"\\([_*#\[\]()`~>+!.\-$%&{}])")


def inline(s: str, languages: set[str]) -> str:
    """A body without inline markup of the languages its text holds."""
    if not _INLINE.search(s):
        return s
    if WIKI in languages:
        for p, to in _STEPS_WIKI:
            s = p.sub(to, s)
    if MARKDOWN in languages:
        for p, to in _STEPS_MD:
            s = p.sub(to, s)
    if LATEX in languages and ("\\" in s or "~" in s):
        for p, to in _STEPS_TEX:
            s = p.sub(to, s)
    return _ESCAPED.sub(r"\1", s) if "\\" in s else s


def clean_text(a: Analysis) -> str:
    """Blocks as plain text: headings with '#', items with '-', code fenced, formulas between '$$'."""
    shapes = {"heading": "# {}", "list_item": "- {}", "code": "```\n{}\n```", "formula": "$$ {} $$"}
    out: list[str] = []
    last = ""
    for kind, body in a.blocks:
        out.append(("\n" if kind == last == "list_item" else "\n\n" if out else "") + shapes.get(kind, "{}").replace("{}", body.strip("\n")))
        last = kind
    return "".join(out)


def markup_elements(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """``(*key, kind, body)``, distinct: a row of kind residue for each markup
    language of an item, and a row for each heading, list item, code block and
    formula. Escapes that Markdown and LaTeX share (``\\_``, ``\\#``) count as LaTeX.
    Items without markup, null and empty texts give no row; bodies have
    single spaces; further columns are ignored, whatever their names."""
    names = [f"k{i}" for i in range(len(key))]
    d = df.selectExpr(*[f"`{k}` AS {n}" for k, n in zip(key, names)], f"`{text}` AS body").filter("body is not null")
    kinds = dict(d.dtypes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_batches(batches, "body"):
            index, kind, body = [], [], []
            for i, x in enumerate(b.column("body").to_pylist()):
                a = analyse(x)
                if a.languages or a.elements:
                    rows = {("residue", y) for y in a.languages} | set(a.elements)
                    index += [i] * len(rows)
                    for k, y in sorted(rows):
                        kind.append(k)
                        body.append(y)
            if index:
                at = pa.array(index, pa.int32())
                yield pa.RecordBatch.from_arrays([*(b.column(n).take(at) for n in names), pa.array(kind), pa.array(body)], names=[*names, "kind", "body"])

    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "kind string, body string"])
    return d.mapInArrow(scan, schema).distinct().withColumnsRenamed(dict(zip(names, key)))


def strip_markup(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """``(*key, clean)``: every item's text without markup but with its
    structure; null texts stay null, texts without markup stay as they are."""
    names = [f"k{i}" for i in range(len(key))]
    d = df.selectExpr(*[f"`{k}` AS {n}" for k, n in zip(key, names)], f"`{text}` AS body")
    kinds = dict(d.dtypes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_batches(batches, "body"):
            clean = []
            for x in b.column("body").to_pylist():
                a = analyse(x)
                clean.append(clean_text(a) if a.languages else x)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(clean, pa.string())], names=[*names, "clean"])

    return d.mapInArrow(scan, ", ".join([*(f"{n} {kinds[n]}" for n in names), "clean string"])).withColumnsRenamed(dict(zip(names, key)))


def found_query(spark: SparkSession, base: str) -> DataFrame:
    return markup_elements(records(spark, base), ["src", "rec_id"], "text")


def clean_query(spark: SparkSession, base: str) -> DataFrame:
    return strip_markup(records(spark, base), ["src", "rec_id"], "text")

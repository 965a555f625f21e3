"""Problem 1: noise in text from scanned pages.

Words counted over all documents give a lexicon. Lines that are page furniture
are told by their form and by breaking off before the page's width; words broken
at line ends are joined, with or without a hyphen as the lexicon has them. For a
word the lexicon doesn't know, symmetric deletes yield candidates: words that
become the same as it where both lose what may have been confused. A weighted
edit distance with pairs of characters that scanners confuse, together with the
words beside it, picks the repair. A typist's slip costs a full edit and is left
alone.

Only frequent words are held by the driver and the workers. Rarer ones are asked
for: a first pass notes the words in question with the words beside them, joins
with the counts of all words and bigrams answer them, and a second pass over the
pages uses the answers.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import ChainMap, Counter, defaultdict
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import cut_batches, documents, materialize, records

#: Share of all words from which the driver and the workers hold a word (at most 1 / share words), and from which it is a usual one.
KNOWN_SHARE, INDEX_SHARE = 4e-6, 1e-5
#: Occurrences from which a word is known and may be a candidate, and from which a bigram counts.
LEAST, LEAST_PAIR = 4, 3
#: Lines longer than this are no lines of a scanned page.
WIDEST = 110
#: Characters of a delete that stand for it.
PREFIX = 16

# What a scanner prints for what stood there.
CONFUSED = [
    ("c", "e"), ("e", "c"), ("i", "r"), ("r", "i"), ("f", "t"), ("t", "f"), ("o", "a"), ("a", "o"), ("b", "h"), ("h", "b"), ("y", "v"), ("v", "y"),
    ("5", "s"), ("1", "i"), ("1", "l"), ("0", "o"), ("9", "g"), ("6", "b"), ("8", "b"), ("2", "z"), ("4", "a"), ("3", "e"), ("7", "t"),
    ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("h", "li"), ("li", "h"),
    ("i", "l"), ("l", "i"), ("nn", "m"), ("in", "m"), ("ć", "é"), ("é", "ć"), ("ii", "ü"), ("6", "ó"), ("0", "ó"), ("0", "ö"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("á", "ó"), ("ó", "á"), ("ö", "ä"), ("ä", "ö"), ("q", "g"), ("g", "q"),
]
CONFUSION_COST, EDIT_COST, MOST_COST = 0.4, 1.0, 0.85

_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_TOKEN = re.compile(r"\S+")
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_BREAK = re.compile(r"([^\W\d_]|\d)([-­¬‐])[ \t\r]*$")
_NUMBER = re.compile(r"[\s\x0c]*(?:Page \w{1,4} of \w{1,4}|\[\w{1,4}\]|[-–—] ?\w{1,7} ?[-–—]|\d{1,4}|(?=\D?\d|\D\D\d)[\dlIoOSBbsgz]{2,4}|(?=[ivxlcdm])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))\s*$", re.I)
_BARRED = re.compile(r"[\s\x0c]*(?:[\dlIoOSBbsgz]{1,4}|[ivxlcdm]{1,5}) \| [^|]{3,50}$|[\s\x0c]*[^|]{3,50} \| (?:[\dlIoOSBbsgz]{1,4}|[ivxlcdm]{1,5})\s*$")
_TITLE = re.compile(r"[\s\x0c]*(?:\w{1,4} \| )?[^\W\d_]\w{3,} [^\W\d_]\w{3,9} (?:\| )?\w{1,3}\s*$")
_ENDS = re.compile(r"[.!?…:;,)»”\"'’]\s*$")
_MARKUP = re.compile(r"</\w|<\w+[ >]|^\s*\||^```|^~~~|\\begin\{", re.M)


_ITEM = re.compile(r"\s*(?:[-*+•#>]+\s|\d{1,3}[.)]\s)|[ \t]{2,}\S|\t")


def even(lengths: list[int]) -> bool:
    """Whether lines fill a common width, as the lines of a page do."""
    top = max(lengths, default=0)
    return len(lengths) >= 4 and top >= 40 and sum(n >= 0.75 * top for n in lengths) >= 0.6 * len(lengths)


def stretches(text: str) -> list[tuple[int, list[str]]]:
    """The stretches of a text that may be of a scanned page, with the number of
    their first line from 0.

    A line wider than ``WIDEST`` is of none unless its neighbours are as wide,
    nor is a line of markup or code between fences. A text without such lines is
    one stretch; of any other only stretches of even width count.
    """
    if "\n" not in text:
        return [(0, [text])] if len(text) <= WIDEST and not _MARKUP.search(text) else []
    at, wide = 0, False
    while at >= 0 and not wide:
        end = text.find("\n", at)
        wide = (end if end >= 0 else len(text)) - at > WIDEST
        at = end + 1 if end >= 0 else -1
    if not wide and not _MARKUP.search(text):
        return [(0, text.split("\n"))]
    lines = text.split("\n")
    if len(lines) < 4:
        return []
    size = [len(x.rstrip()) for x in lines]
    if wide and sum(30 <= n <= WIDEST for n in size) < 3 and min(sorted(size)[-4:]) <= WIDEST:
        return []
    good, fenced = [], False
    for i, x in enumerate(lines):
        fence = x.startswith(("```", "~~~"))
        beside = [n for n in size[max(0, i - 1) : i] + size[i + 1 : i + 2]]
        fits = size[i] <= WIDEST or len(beside) == 2 and all(abs(n - size[i]) <= 0.1 * size[i] for n in beside)
        good.append(fits and not fence and not fenced and not _MARKUP.search(x))
        fenced ^= fence
    out, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and good[j] == good[i]:
            j += 1
        if good[i] and even([n for n in size[i:j] if n]):
            out.append((i, lines[i:j]))
        i = j
    return out


def furniture(lines: list[str]) -> list[bool]:
    """Which lines are running headers, footers or page numbers.

    A page number has a form of its own. A header beside one begins with a
    capital, ends in no punctuation, and stops although the next line's first
    word would have fitted.
    """
    n = len(lines)
    out = [bool(x.strip()) and bool(_NUMBER.match(x) or _BARRED.match(x)) for x in lines]
    width = max((len(x.rstrip()) for x, f in zip(lines, out) if not f), default=0)
    anchor = [bool(f) for f in out]

    def short(i: int) -> bool:
        x = lines[i].strip()
        if not x or len(x) > 60 or _ENDS.search(x) or _BREAK.search(x):
            return False
        if not (x[0].isupper() or x[0].isdigit()) or x.count("|") > 1:
            return False
        j = i + 1
        while j < n and out[j]:
            j += 1
        following = lines[j].split() if j < n else []
        if not following:
            return True
        return len(x) + 1 + len(following[0]) <= width - 1

    for i in range(n):
        if out[i]:
            continue
        title = bool(_TITLE.match(lines[i])) and lines[i].strip()[:1].isupper() and any(c.isdigit() for c in lines[i][-4:])
        beside = (i > 0 and anchor[i - 1]) or (title and i + 1 < n and anchor[i + 1])
        if beside and short(i):
            out[i] = True
        elif title and lines[i][:1] == "\x0c" and short(i):
            out[i] = True
    plain = [re.sub(r"[\W\d_]+", " ", x).strip().lower() for x in lines]
    known = Counter(p for p, f in zip(plain, out) if f and len(p) > 6)
    loose = [i for i in range(n) if not out[i] and len(plain[i]) > 6 and short(i)]
    again = Counter(plain[i] for i in loose)
    for i in loose:
        inside = 0 < i < n - 1 and lines[i - 1].strip() and lines[i + 1].strip()
        title = bool(_TITLE.match(lines[i])) and lines[i].rstrip()[-1:].isdigit()
        amid = inside and not _ENDS.search(lines[i - 1]) and ". " not in lines[i] and lines[i].strip()[0].isupper() and (lines[i + 1].lstrip()[:1].islower() or lines[i + 1].lstrip()[:1].isdigit()) and "_" not in lines[i + 1].split()[0]
        if amid or known[plain[i]] or inside and again[plain[i]] > 1 or title and (inside or lines[i][:1].isspace()):
            out[i] = True
    return out


_PAIRS: dict[str, list[tuple[str, str]]] = defaultdict(list)
#: What a delete takes out, by its first character: of a word as read, and of one that may be meant.
_SEEN: dict[str, set[str]] = defaultdict(set)
_MEANT: dict[str, set[str]] = defaultdict(set)
for _a, _b in CONFUSED:
    _PAIRS[_a[-1]].append((_a, _b))
    _SEEN[_a[0]].add(_a)
    _MEANT[_b[0]].add(_b)


def deletes(word: str, most: int, parts: dict[str, set[str]]) -> set[str]:
    """All a word becomes by losing one to ``most`` of the parts, with a mark where each stood.

    What was read and what was meant have a delete in common if they are that
    many confusions apart, and any other edit costs more than a repair may. Of a
    long delete the first ``PREFIX`` characters and the length stand for it, so
    parts further on are only told by how much shorter they leave the word.
    """
    at = [(i, i + len(a)) for i, c in enumerate(word[: PREFIX + 2]) for a in parts.get(c, ()) if word.startswith(a, i)]
    far = {len(a) - 1 for i in range(PREFIX + 2, len(word)) for a in parts.get(word[i], ()) if word.startswith(a, i)}
    # What up to two parts further on take away, by how many may still go.
    gone = [{0}, {0} | far, {0} | far | {a + b for a in far for b in far}]
    level = {(0, "")}
    out = {word[:PREFIX] + str(len(word) - x) for x in (gone[most] if far else ())}
    for left in range(most - 1, -1, -1):
        level = {(j, head + word[end:i] + "\0") for end, head in level for i, j in at if i >= end}
        for end, head in level:
            x = head + word[end:]
            if len(x) <= PREFIX:
                out.add(x)
            else:
                out |= {x[:PREFIX] + str(len(x) - y) for y in gone[left]}
    return out


def most_cost(word: str) -> float:
    return MOST_COST if len(word) > 5 else CONFUSION_COST + 0.05


def seen_deletes(word: str) -> set[str]:
    return deletes(word, int(most_cost(word) / CONFUSION_COST), _SEEN)


def meant_deletes(word: str) -> set[str]:
    """Those of any word this one may be read as, which is two characters longer at most."""
    return deletes(word, int(most_cost(word + "  ") / CONFUSION_COST), _MEANT)


def cost(seen: str, meant: str) -> float:
    """``distance`` if it is below a full edit. The two sides of a confusion begin
    and end differently, so what words have in common at their ends is no part of one."""
    i, n = 0, min(len(seen), len(meant))
    while i < n and seen[i] == meant[i]:
        i += 1
    j = 0
    while j < n - i and seen[-1 - j] == meant[-1 - j]:
        j += 1
    return distance(seen[i : len(seen) - j], meant[i : len(meant) - j])


def distance(seen: str, meant: str) -> float:
    """Weighted edit distance; confusions are cheap, all else costs a full edit."""
    n, m = len(seen), len(meant)
    if abs(n - m) > 2:
        return 9.0
    d: list[list[float]] = []
    for i in range(n + 1):
        row = [9.0] * (m + 1)
        d.append(row)
        if i > 2:
            d[i - 3] = []
        # What is further from the diagonal has cost more than a full edit.
        for j in range(max(0, i - 2), min(m, i + 2) + 1):
            if not i and not j:
                row[0] = 0.0
            if i and j:
                best = d[i - 1][j - 1] + (0.0 if seen[i - 1] == meant[j - 1] else EDIT_COST)
                if best < row[j]:
                    row[j] = best
                for a, b in _PAIRS.get(seen[i - 1], ()):
                    if len(a) <= i and len(b) <= j and meant[j - len(b) : j] == b and seen[i - len(a) : i] == a:
                        x = d[i - len(a)][j - len(b)] + CONFUSION_COST
                        if x < row[j]:
                            row[j] = x
            if i and d[i - 1][j] + EDIT_COST < row[j]:
                row[j] = d[i - 1][j] + EDIT_COST
            if j and row[j - 1] + EDIT_COST < row[j]:
                row[j] = row[j - 1] + EDIT_COST
    return d[n][m]


class Deletes:
    """The words of a lexicon by the codes of their deletes, in sorted arrays."""

    def __init__(self, words: dict[str, int]):
        self.words = [w for w, n in words.items() if n >= LEAST and Lexicon.fits(w)]
        self.counts = np.fromiter((words[w] for w in self.words), dtype=np.int64, count=len(self.words))
        keys, of = array("Q"), array("q")
        for i, w in enumerate(self.words):
            found = meant_deletes(w)
            keys.extend(map(_code, found))
            of.append(len(found))
        codes = np.frombuffer(keys, dtype=np.uint64) if keys else np.zeros(0, dtype=np.uint64)
        order = np.argsort(codes, kind="stable")
        self.keys = codes[order]
        self.at = np.repeat(np.arange(len(self.words), dtype=np.int32), np.frombuffer(of, dtype=np.int64) if of else 0)[order]

    def near(self, word: str, least: int) -> list[str]:
        """Words seen ``least`` times or more that have a delete in common with this one."""
        codes = np.fromiter(map(_code, seen_deletes(word)), dtype=np.uint64)
        low, high = np.searchsorted(self.keys, codes), np.searchsorted(self.keys, codes, "right")
        hits = [self.at[a:b] for a, b in zip(low.tolist(), high.tolist()) if a < b]
        if not hits:
            return []
        found = np.unique(np.concatenate(hits))
        return [self.words[i] for i in found[self.counts[found] >= least].tolist()]


_KEPT: list[dict] = []
#: Entries a worker keeps of what it has worked out about words.
MOST_KEPT = 200_000
#: Deletes given out at a time.
MOST_DELETES = 200_000


class Lexicon:
    """Word and bigram counts. A learned one holds the usual words and has all
    counts as tables besides."""

    def __init__(self, words: dict[str, int], total: int, pairs: dict[tuple[str, str], int] | None = None):
        self.words, self.pairs = words, pairs or {}
        self.usual = max(8.0, total * INDEX_SHARE)
        self.index = Deletes(words)
        self.settled: dict[str, list[tuple[float, str]]] = {}
        self.memo: dict[str, list[tuple[float, str]]] = {}
        self.nothing: dict[str, bool] = {}
        self.counts: DataFrame | None = None
        self.bigrams: DataFrame | None = None

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "nothing": {}, "counts": None, "bigrams": None}

    def __setstate__(self, state):
        """A worker that gets another lexicon gives up what it kept for the last one."""
        for kept in _KEPT:
            kept.clear()
        self.__dict__.update(state)
        self.memo, self.nothing = {}, {}
        _KEPT[:] = [self.memo, self.nothing]

    def settle(self) -> None:
        """Work out the candidates of all words held, so that no worker has to."""
        self.settled = {w: self.candidates(w) for w in self.words}
        self.memo.clear()

    def candidates(self, word: str) -> list[tuple[float, str]]:
        """Words a scanner may have read as this one, by cost and frequency."""
        found = self.settled.get(word)
        if found is None:
            found = self.memo.get(word)
        if found is None:
            near = [(k, -self.words[c], c) for c in self.near(word, max(LEAST, 20 * self.words.get(word, 0))) if c != word and (k := cost(word, c)) <= most_cost(word) and not self.misread(c)]
            found = [(k, c) for k, _, c in sorted(near)]
            if len(self.memo) > MOST_KEPT:
                self.memo.clear()
            self.memo[word] = found
        return found

    def near(self, word: str, least: int) -> list[str]:
        return self.index.near(word, least)

    def misread(self, c: str) -> bool:
        """Whether a word is one that would be repaired itself, and so not what is meant."""
        return len(c) > 4 and self.words[c] < self.usual and bool(self.candidates(c))

    def furniture(self, lines: list[str]) -> list[bool]:
        return furniture(lines)

    @staticmethod
    def fits(c: str) -> bool:
        return len(c) > 1 and not any(x.isdigit() for x in c)

    def plain(self, word: str) -> bool:
        """Whether a word is known and nothing else can be meant."""
        return self.words.get(word, 0) > 0 and not self.candidates(word)

    def right(self, word: str) -> bool:
        """Whether there is nothing to repair in a word: it has no letters, or is
        known and nothing else can be meant. Kept for the words held."""
        found = self.nothing.get(word)
        if found is None:
            found = len(word) < 2 or not any(c.isalpha() for c in word) or word in self.words and Lexicon.plain(self, word)
            if len(self.nothing) > MOST_KEPT:
                self.nothing.clear()
            self.nothing[word] = found
        return found

    def beside(self, before: str, word: str, after: str) -> int:
        return self.pairs.get((before, word), 0) + self.pairs.get((word, after), 0)

    def repair(self, word: str, before: str, after: str) -> str | None:
        """What a misread word should be, or None if it is right or unclear."""
        found = self.candidates(word)
        if not found:
            return None
        b, a = self.name(before), self.name(after)
        own = self.words.get(word, 0)
        ranked = sorted(found, key=lambda x: (round(x[0] / CONFUSION_COST), -self.beside(b, x[1], a), -self.words[x[1]]))
        best = ranked[0][1]
        digits = any(c.isdigit() for c in word)
        support = self.beside(b, best, a)
        if digits and any(c.isalpha() for c in word):
            return best if len(word) > 2 or support >= 5 else None
        if len(word) <= 3 or own >= self.usual:
            return best if support >= 5 * (self.beside(b, word, a) + 1) else None
        if len(word) == 4 and own >= 3:
            return best if support > self.beside(b, word, a) else None
        return best

    def name(self, word: str) -> str:
        """A word in the bigram table: itself, or that it is a number or unknown."""
        if word in self.words and self.words[word] >= self.usual:
            return word
        return "<9>" if word[:1].isdigit() else "<o>" if word else ""

    def join(self, left: str, right: str, sign: str) -> str:
        """A word broken at a line end, with a hyphen only if it has one itself."""
        whole, own = left + right, f"{left}-{right}"
        a, b = self.words.get(whole, 0), self.words.get(own, 0)
        if a or b:
            return whole if a >= b else own
        if right[:1].isdigit() or left[-1:].isdigit():
            return own if sign == "-" else whole
        if (c := self.candidates(whole)) or not (d := self.candidates(own)):
            return c[0][1] if c else whole
        return d[0][1]


class Asking(Lexicon):
    """Notes what a text asks of the lexicon: ``(kind, w, b, a, look, near)``.

    ``look`` are the words not held here. A held word's candidates are at least
    20 times as frequent and so held as well: ``near``.
    """

    def __init__(self, held: Lexicon):
        self.__dict__.update(held.__dict__)
        self.asked: dict[tuple[str, str, str, str], tuple[list[str], list[str]]] = {}
        self.joined: set[str] = set()
        self.side: list[bool] = []

    def furniture(self, lines: list[str]) -> list[bool]:
        side = furniture(lines)
        self.side += side
        return side

    def repair(self, word: str, before: str, after: str) -> str | None:
        near = [c for _, c in self.candidates(word)] if word in self.words else []
        if near or word not in self.words:
            # A joined word may come out otherwise when rarer words are known; it is no usual one then.
            for b in {self.name(before), "<o>"} if before in self.joined else {self.name(before)}:
                for a in {self.name(after), "<o>"} if after in self.joined else {self.name(after)}:
                    self.asked["word", word, b, a] = ([] if word in self.words else [word], near)
        return None

    def join(self, left: str, right: str, sign: str) -> str:
        self.asked["join", left, right, sign] = ([x for x in (left + right, f"{left}-{right}") if x not in self.words], [])
        fixed = super().join(left, right, sign)
        self.joined.add(fixed)
        return fixed


class Answered(Lexicon):
    """The answers to what a text has asked."""

    def __init__(self, held: Lexicon, answers: list, side: list[bool]):
        self.__dict__.update(held.__dict__)
        self.side = iter(side)
        self.fixed = {(r["kind"], r["w"], r["b"], r["a"]): r["fixed"] for r in answers}
        self.sure = {r["w"] for r in answers if r["sure"]}

    def furniture(self, lines: list[str]) -> list[bool]:
        return [next(self.side) for _ in lines]

    def right(self, word: str) -> bool:
        return super().right(word) or word in self.sure and word not in self.words

    def repair(self, word: str, before: str, after: str) -> str | None:
        return self.fixed.get(("word", word, self.name(before), self.name(after)))

    def join(self, left: str, right: str, sign: str) -> str:
        return self.fixed.get(("join", left, right, sign)) or super().join(left, right, sign)


def bare(token: str) -> str:
    return _EDGE.sub("", token).lower()


_FILE = re.compile(r"[_*@/\\]|\.\w")
_BARE: dict[str, str] = {}


def _bare(token: str) -> str:
    """The word in a token, none in names of files and the like; kept for tokens seen."""
    word = "" if _FILE.search(token.rstrip(".,;:!?)»”\"'")) else bare(token)
    if len(_BARE) > MOST_KEPT:
        _BARE.clear()
    _BARE[token] = word
    return word


class Token:
    """A word of a page: its line, its letters as read, what they are and, for a
    word broken at the line's end, whether it is joined."""

    __slots__ = ("line", "raw", "word", "joined", "fixed")

    def __init__(self, line: int, raw: str, word: str, joined: bool = False):
        self.line, self.raw, self.word, self.joined, self.fixed = line, raw, word, joined, ""


def reading(lines: list[str], side: list[bool], lexicon: Lexicon) -> list[Token]:
    """The words of a page's running text, broken ones joined and misread ones with
    what they should be."""
    flow = [i for i, (x, f) in enumerate(zip(lines, side)) if not f and x.strip()]
    out: list[Token] = []
    carry: tuple[int, str, str] | None = None  # line, beginning of a word, its sign
    for at, i in enumerate(flow):
        tokens = _TOKEN.findall(lines[i].replace("\x0c", " "))
        if carry:
            no, left, sign = carry
            right = tokens[0]
            if bare(right) and right[0].isalnum():
                fixed = lexicon.join(bare(left), bare(right), sign)
                tail = right[len(right.rstrip(".,;:!?)»”\"'")) :]
                same = bare(left + right).replace("-", "") == fixed.replace("-", "")
                out.append(Token(no, (left + ("-" if "-" in fixed and "-" not in left + right else "") + right) if same else fixed + tail, fixed, True))
                tokens = tokens[1:]
            else:
                out.append(Token(no, left + sign, ""))
            carry = None
        m = _BREAK.search(lines[i])
        if m and tokens and at + 1 < len(flow):
            left = tokens[-1].rstrip("-­¬‐")
            if bare(left) and lines[flow[at + 1]].strip()[:1].isalnum():
                carry = (i, left, m.group(2))
                tokens = tokens[:-1]
        out += [Token(i, t, w if (w := _BARE.get(t)) is not None else _bare(t)) for t in tokens]
    for k, t in enumerate(out):
        w = t.word
        if lexicon.right(w):
            continue
        before, after = out[k - 1].word if k else "", out[k + 1].word if k + 1 < len(out) else ""
        fixed = lexicon.repair(w, before, after)
        if fixed and fixed != w:
            t.fixed = fixed
        elif not fixed and ("’" in w or "-" in w):
            parts = re.split(r"([’'-])", w)
            better = [p if len(p) < 3 or p in "’'-" else (lexicon.repair(p, "", "") or p) for p in parts]
            if better != parts:
                t.fixed = "".join(better)
    return out


def cases(text: str, lexicon: Lexicon) -> list[tuple[int, str, str]]:
    """``(line_no, kind, fixed)`` of a text."""
    out = []
    for first, lines in stretches(text) if text else []:
        side = lexicon.furniture(lines)
        out += [(first + i + 1, "furniture", "") for i, f in enumerate(side) if f]
        for t in reading(lines, side, lexicon):
            if t.joined:
                out.append((first + t.line + 1, "hyphen", t.word))
            if t.fixed:
                out.append((first + t.line + 1, "char", t.fixed))
    return out


def _written(t: Token) -> str:
    """A word as it should stand: the repair with the case and signs of what was read."""
    if not t.fixed:
        return t.raw
    head = t.raw[: len(t.raw) - len(re.sub(r"^\W+", "", t.raw))]
    tail = re.search(r"\W*$", t.raw).group()
    return head + (t.fixed[:1].upper() + t.fixed[1:] if t.raw[len(head) : len(head) + 1].isupper() else t.fixed) + tail


def _page(lines: list[str], lexicon: Lexicon) -> list[str]:
    """A stretch's lines: running text in one line a paragraph where something
    shows that it is a page's (furniture, broken words, even width), without
    furniture. Headings, items, code and other lines that end before the width
    stay lines of their own; without such a sign all lines stay."""
    side = lexicon.furniture(lines)
    tokens = reading(lines, side, lexicon)
    if not any(side) and not any(t.joined for t in tokens) and not even([len(x.rstrip()) for x in lines if x.strip()]):
        if not any(t.fixed for t in tokens):
            return lines
        new = list(lines)
        for t in tokens:
            if t.fixed:
                new[t.line] = new[t.line].replace(t.raw, _written(t), 1)
        return new
    of: dict[int, list[Token]] = defaultdict(list)
    for t in tokens:
        of[t.line].append(t)
    sizes = sorted(len(x.strip()) for x, f in zip(lines, side) if not f and x.strip())
    width = sizes[int(0.9 * (len(sizes) - 1))] if sizes else 0
    out: list[str] = []
    before = -1  # the last line of running text
    blank = False
    for i, x in enumerate(lines):
        if side[i]:
            continue
        if not x.strip():
            # A blank line beside furniture is the page's and not the text's, unless a sentence ends there.
            page = (i and side[i - 1]) or (i + 1 < len(side) and side[i + 1])
            blank = blank or before >= 0 and not (page and not _ENDS.search(lines[before]))
            continue
        words = [_written(t) for t in of[i]]
        joined = before >= 0 and of[before] and of[before][-1].joined and of[before][-1].line == before
        if before >= 0:
            y, first = lines[before].strip(), x.split()[0]
            full = len(y) + 1 + len(first) >= width - 3
            on = x.lstrip()[:1].islower() and not _ENDS.search(y) and len(y) >= 0.5 * width
            item = bool(_ITEM.match(x))
            if joined or not blank and not item and (full or on):
                out[-1] = " ".join([out[-1], *words]) if words else out[-1]
            else:
                if blank:
                    out.append("")
                out.append(" ".join(words) if not x[:1].isspace() or not item else re.match(r"\s*", x).group() + " ".join(words))
        else:
            out.append(" ".join(words))
        before, blank = i, False
    return out


def repaired(text: str | None, lexicon: Lexicon) -> str | None:
    """A text with its scanned stretches as continuous paragraphs; all else as it is."""
    if not text:
        return text
    found = stretches(text)
    if not found:
        return text
    lines = text.split("\n")
    out, at = [], 0
    for first, page in found:
        blank = [bool(x.strip()) for x in page]
        lead, trail = (blank.index(True), blank[::-1].index(True)) if any(blank) and len(page) < len(lines) else (0, 0)
        out += lines[at:first] + [""] * lead + _page(page, lexicon) + [""] * trail
        at = first + len(page)
    return "\n".join(out + lines[at:])


def _code(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _pair_code(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One value for two words' codes, in this order."""
    k = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(0x165667B19E3779F9))
    k = (k ^ (k >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (k ^ (k >> np.uint64(29))).astype(np.int64)


def learn(df: DataFrame, text: str) -> Lexicon:
    """The lexicon of all texts. Words above ``KNOWN_SHARE`` of all words come to
    the driver; the counts of all words and bigrams stay tables. In a bigram the
    word beside is itself if usual, else that it is a number or unknown."""
    d = df.select(F.col(f"`{text}`").alias("body")).filter("body is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_batches(batches, "body", 16_000_000):
            to: Counter = Counter()
            for x in b.column("body").to_pylist():
                to.update(_WORD.findall(x.lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(to), pa.string()), pa.array(list(to.values()), pa.int64())], names=["w", "n"])

    c = materialize(d.mapInArrow(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")), "words")
    total = c.agg(F.sum("n")).first()[0] or 0
    words = {r.w: r.n for r in c.filter(F.col("n") >= max(LEAST, math.ceil(total * KNOWN_SHARE))).collect()}
    lexicon = Lexicon(words, total)
    lexicon.settle()
    usual = {w for w, n in words.items() if n >= lexicon.usual}

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_batches(batches, "body", 8_000_000):
            ids: dict[str, int] = {"": 0}
            flat = [0]
            for x in b.column("body").to_pylist():
                flat.extend([ids.setdefault(w, len(ids)) for w in _WORD.findall(x.lower())])
                flat.append(0)
            codes = np.fromiter(map(_code, ids), dtype=np.uint64, count=len(ids))
            named = np.fromiter((_code(w if not w or w in usual else "<9>" if w[0].isdigit() else "<o>") for w in ids), dtype=np.uint64, count=len(ids))
            at = np.asarray(flat, dtype=np.int64)
            own, name = codes[at], named[at]
            both = (own[:-1] == name[:-1]) & (own[1:] == name[1:])
            k = np.concatenate([_pair_code(name[:-1], own[1:]), _pair_code(own[:-1][~both], name[1:][~both])])
            k, n = np.unique(k, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], names=["k", "n"])

    lexicon.counts = c.filter(F.col("n") >= LEAST)
    lexicon.bigrams = materialize(d.mapInArrow(pair, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_PAIR), "bigrams")
    return lexicon


def _joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffle, whatever the settings: the bytes of a file, and what they are
    taken for after a step in Python, are a small part of what the rows take in the
    driver, so neither side is to be broadcast for them."""
    return left.join(right.hint("merge"), on, how)


_ASK = "kind string, w string, b string, a string, look array<string>, near array<string>"


def _candidates(asked: DataFrame, counts: DataFrame, usual: float) -> DataFrame:
    """``(w, own, cands)`` of asked words: their own count and all words above
    ``LEAST`` that a scanner may have read so, without those misread themselves.
    The deletes of both are joined, and the weighted distance tells which are near."""

    def by_code(column: str, made):
        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                index, x = array("i"), array("Q")
                for i, w in enumerate(b.column(column).to_pylist()):
                    x.extend(map(_code, made(w)))
                    index.extend([i] * (len(x) - len(index)))
                    if len(x) > MOST_DELETES or i + 1 == b.num_rows:
                        at = pa.array(np.frombuffer(index, dtype=np.int32) if index else [], pa.int32())
                        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, dtype=np.int64) if x else [], pa.int64()), *(c.take(at) for c in b.columns)], names=["x", *b.schema.names])
                        index, x = array("i"), array("Q")

        return code

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([i for i, (w, c) in enumerate(zip(b.column("w").to_pylist(), b.column("c").to_pylist())) if cost(w, c) <= most_cost(w)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(n).take(keep) for n in ("w", "c", "n")], names=["w", "c", "n"])

    # Lines of a page are bounded, and so is a word joined from two of them.
    meant = counts.filter(f"length(w) between 2 and {2 * WIDEST + 9} and not w rlike '\\\\p{{Nd}}'").select(F.col("w").alias("c"), "n")

    def pairs(words: DataFrame, meant: DataFrame) -> DataFrame:
        left = words.mapInArrow(by_code("w", seen_deletes), "x bigint, w string")
        right = meant.mapInArrow(by_code("c", meant_deletes), "x bigint, c string, n bigint")
        return _joined(left, right, "x").filter("w <> c").select("w", "c", "n").distinct().mapInArrow(near, "w string, c string, n bigint")

    found = materialize(pairs(asked.filter(F.length("w") <= 2 * WIDEST + 11), meant), "near")
    doubtful = found.filter((F.col("n") < usual) & (F.length("c") > 4)).select(F.col("c").alias("w"), F.col("n").alias("own")).distinct()
    # A word counted is counted LEAST times, and one meant 20 times as often.
    misread = _joined(pairs(doubtful.select("w"), meant.filter(F.col("n") >= 20 * LEAST)), doubtful, "w").filter("n >= 20 * own").select(F.col("w").alias("c")).distinct()
    found = _joined(found, misread, "c", "left_anti")
    own = _joined(asked, counts, "w").select("w", F.col("n").alias("own"))
    found = found.groupBy("w").agg(F.collect_list(F.struct("c", "n")).alias("cands"))
    return _joined(own, found, "w", "full").select("w", F.coalesce("own", F.lit(0)).alias("own"), "cands")


def _answers(asks: DataFrame, lexicon: Lexicon, shared) -> DataFrame:
    """``(kind, w, b, a, fixed, sure)`` for distinct asks."""
    ask = ["kind", "w", "b", "a"]
    facts = materialize(_candidates(asks.select(F.explode("look").alias("w")).distinct(), lexicon.counts, lexicon.usual), "facts")
    known = facts.select(F.col("w").alias("x"), F.struct(F.col("w").alias("x"), "own", "cands").alias("fact"))
    told = _joined(asks.select(*ask, "near", F.explode_outer("look").alias("x")), known, "x", "left").groupBy(*ask).agg(F.first("near").alias("near"), F.collect_list("fact").alias("facts"))
    told = materialize(told.filter("kind = 'join' or size(near) > 0 or size(facts) > 0"), "told")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, left, right = [], [], []
            for r in batch.to_pylist():
                options = {c["c"] for f in r["facts"] for c in f["cands"] or ()} | set(r["near"])
                for x in {r["w"], *options} if options else ():
                    rows += [(r["w"], r["b"], r["a"], x)] * 2
                    left += [_code(r["b"]), _code(x)]
                    right += [_code(x), _code(r["a"])]
            k = _pair_code(np.asarray(left, dtype=np.uint64), np.asarray(right, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.string()) for i in range(4)), pa.array(k)], names=["w", "b", "a", "x", "k"])

    support = _joined(told.filter("kind = 'word'").mapInArrow(keys, "w string, b string, a string, x string, k bigint"), lexicon.bigrams, "k")
    support = support.groupBy("w", "b", "a", "x").agg(F.sum("n").alias("n")).groupBy("w", "b", "a").agg(F.collect_list(F.struct("x", "n")).alias("support")).withColumn("kind", F.lit("word"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            fixed, sure = [], []
            for r in batch.to_pylist():
                more = {c["c"]: c["n"] for f in r["facts"] for c in f["cands"] or ()} | {f["x"]: f["own"] for f in r["facts"] if f["own"]}
                one = _One(held, more, {x["x"]: x["n"] for x in r["support"] or ()})
                fixed.append(one.join(r["w"], r["b"], r["a"]) if r["kind"] == "join" else one.repair(r["w"], r["b"], r["a"]))
                sure.append(r["kind"] == "word" and one.plain(r["w"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ask), pa.array(fixed, pa.string()), pa.array(sure, pa.bool_())], names=[*ask, "fixed", "sure"])

    return _joined(told, support, [*ask], "left").mapInArrow(answer, "kind string, w string, b string, a string, fixed string, sure boolean").filter("fixed is not null or sure")


class _One(Lexicon):
    """What the lexicon has for one ask: ``b`` and ``a`` are names already."""

    def __init__(self, held: Lexicon, more: dict[str, int], support: dict[str, int]):
        self.words, self.pairs, self.usual, self.memo, self.support = ChainMap(more, held.words), held.pairs, held.usual, {}, support
        self.index, self.settled, self.more = held.index, held.settled, more

    def near(self, word: str, least: int) -> list[str]:
        return list({*super().near(word, least), *(c for c, n in self.more.items() if n >= least and self.fits(c))})

    def name(self, word: str) -> str:
        return word

    def beside(self, before: str, word: str, after: str) -> int:
        return self.support.get(word, 0) + super().beside(before, word, after)


def _pages(df: DataFrame, key: list[str], text: str, lexicon: Lexicon, use, shared) -> DataFrame:
    """``(k0, .., body, side, answers)``: scanned texts with the furniture among
    their lines and the answers to all that ``use`` asks of the lexicon."""
    d = df.selectExpr(*[f"`{k}` AS k{i}" for i, k in enumerate(key)], f"`{text}` AS body").filter("body is not null")
    names = d.columns

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_batches(batches, "body"):
            index, asks, sides = [], [], []
            for i, x in enumerate(b.column("body").to_pylist()):
                if x and stretches(x):
                    to = Asking(shared.value)
                    use(x, to)
                    index.append(i)
                    sides.append(to.side)
                    asks.append([dict(zip(("kind", "w", "b", "a", "look", "near"), (*k, *v))) for k, v in to.asked.items()])
            at = pa.array(index, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(n).take(at) for n in names), pa.array(sides, pa.list_(pa.bool_())), pa.array(asks, _ASKS)], names=[*names, "side", "asks"])

    schema = ", ".join(f"{n} {t}" for n, t in d.dtypes)
    pages = materialize(d.mapInArrow(ask, f"{schema}, side array<boolean>, asks array<struct<{_ASK.replace(' ', ':').replace(',:', ',')}>>").withColumn("th", F.xxhash64("body")), "pages")
    if lexicon.counts is None:
        empty = df.sparkSession.createDataFrame([], "w string, n bigint")
        lexicon = copy(lexicon)
        lexicon.counts, lexicon.bigrams = empty, empty.select(F.lit(0).cast("bigint").alias("k"), "n")
    flat = pages.select("th", F.explode("asks").alias("q")).select("th", "q.*")
    answers = materialize(_answers(flat.drop("th").dropDuplicates(["kind", "w", "b", "a"]), lexicon, shared), "answers")
    per = _joined(flat.select("th", "kind", "w", "b", "a").distinct(), answers, ["kind", "w", "b", "a"]).groupBy("th").agg(F.collect_list(F.struct("kind", "w", "b", "a", "fixed", "sure")).alias("answers"))
    return _joined(pages.select(*names, "side", "th"), per, "th", "left").drop("th")


_ASKS = pa.list_(pa.struct([("kind", pa.string()), ("w", pa.string()), ("b", pa.string()), ("a", pa.string()), ("look", pa.list_(pa.string())), ("near", pa.list_(pa.string()))]))


def scan_noise(df: DataFrame, key: list[str], text: str, lexicon: Lexicon) -> DataFrame:
    """``(*key, line_no, kind, fixed)``, distinct, of furniture, broken words and
    misread words. Null and empty texts and stretches of lines wider than a page
    or with markup give no row; further columns are ignored."""
    names = [f"k{i}" for i in range(len(key))]
    shared = df.sparkSession.sparkContext.broadcast(lexicon)
    d = _pages(df, key, text, lexicon, cases, shared)
    kinds = dict(d.dtypes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_batches(batches, "body"):
            index, rows = [], []
            for i, (x, to, side) in enumerate(zip(*(b.column(n).to_pylist() for n in ("body", "answers", "side")))):
                found = cases(x, Answered(shared.value, to or [], side))
                index += [i] * len(found)
                rows += found
            if rows:
                at = pa.array(index, pa.int32())
                yield pa.RecordBatch.from_arrays([*(b.column(n).take(at) for n in names), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=[*names, "line_no", "kind", "fixed"])

    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "line_no int, kind string, fixed string"])
    return d.mapInArrow(scan, schema).distinct().withColumnsRenamed(dict(zip(names, key)))


def repair_scans(df: DataFrame, key: list[str], text: str, lexicon: Lexicon) -> DataFrame:
    """``(*key, clean)``: every text with its scanned stretches as continuous
    paragraphs; other texts and nulls stay as they are."""
    names = [f"k{i}" for i in range(len(key))]
    shared = df.sparkSession.sparkContext.broadcast(lexicon)
    d = _pages(df, key, text, lexicon, repaired, shared)
    kinds = dict(d.dtypes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_batches(batches, "body"):
            clean = [repaired(x, Answered(shared.value, to or [], side)) for x, to, side in zip(*(b.column(n).to_pylist() for n in ("body", "answers", "side")))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(clean, pa.string())], names=[*names, "clean"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_batches(batches, "body"):
            at = pa.array([i for i, x in enumerate(b.column("body").to_pylist()) if not x or not stretches(x)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(n).take(at) for n in (*names, "body")], names=[*names, "clean"])

    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "clean string"])
    other = df.selectExpr(*[f"`{k}` AS {n}" for k, n in zip(key, names)], f"`{text}` AS body")
    return d.mapInArrow(scan, schema).unionByName(other.mapInArrow(rest, schema)).withColumnsRenamed(dict(zip(names, key)))


def found_query(spark: SparkSession, base: str) -> DataFrame:
    return scan_noise(records(spark, base), ["src", "rec_id"], "text", learn(documents(spark, base), "text"))


def repaired_query(spark: SparkSession, base: str) -> DataFrame:
    return repair_scans(records(spark, base), ["src", "rec_id"], "text", learn(documents(spark, base), "text"))

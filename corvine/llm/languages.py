"""Problem 2: languages of documents, chunks and their segments.

A language's profile lists its most frequent n-grams by rank. Every sentence's
own ranking is compared with all profiles by out-of-place distance; the nearest
profile names the language and the distance of the next gives the confidence.
The sentences of a batch of texts are ranked together in arrays. Profiles are
learned from a bounded sample of labelled documents, whose labels may be wrong
here and there: what the first profiles call another language is left out of the
second ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.llm.common import chunks, cut_batches, documents
from corvine.llm.markup import _ANY, analyse

LANGUAGES = ("en", "fr", "de", "es", "pt", "ru", "zh", "ja", "th", "hi")
#: Documents a label and sentences of each, picked by hash, that teach the profiles.
SAMPLE_DOCS, SAMPLE_SENTENCES = 100, 40
#: N-grams in a profile, the longest n-gram, and n-grams in a sentence's ranking.
PROFILE, LONGEST, OWN = 600, 4, 300
_ABSENT = 20_000
#: Share by which the second language must be farther off for a sentence to stand against its
#: record's main language, and what a sentence of one word needs besides (of n words, that over n squared).
MARGIN, SHORT = 0.05, 0.5

_SENTENCE = re.compile(r"[.!?…]+[\"'»”’)\]]*(?:\s*[»“])?(?=\s+[\"'«“„‘(¿¡]*\s?[A-ZÀ-ÞА-Яऀ-ॿ぀-ヿ一-鿿฀-๿])|(?<=[a-zß-öø-ÿ)])[.!?](?=[A-ZÀ-Þ][a-zß-öø-ÿ]+\s)|[。！？।]+[」』”）]*")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_TERMINAL = re.compile(r"[.!?…。！？।][\"'»”’“)\]」』）]*\s*$")
_LOWER = re.compile(r"(?<![\w.*/@-])[a-zß-öø-ÿœ]+(?:['’][a-zß-öø-ÿœ]+)*(?![\w@]|[.-]\w)")
_ELISION = re.compile(r"(?<![\w])[a-zß-öø-ÿ]{1,2}['’](?=[A-Z])")
_NON_LATIN = re.compile(r"[Ѐ-ӿऀ-ॿ฀-๿぀-ヿ㐀-鿿]+")
_SCRIPTS = {"y": ("ru",), "d": ("hi",), "t": ("th",), "c": ("zh", "ja"), "l": ("en", "fr", "de", "es", "pt")}
_SCRIPT_OF = {x: s for s, xs in _SCRIPTS.items() for x in xs}


def script(c: str) -> str:
    return "y" if "Ѐ" <= c <= "ӿ" else "d" if "ऀ" <= c <= "ॿ" else "t" if "฀" <= c <= "๿" else "c" if "぀" <= c <= "鿿" else "l"


def skeleton(sentence: str) -> str:
    """Evidence of a sentence: its lower-case words, or its letters in another
    script, of scripts without spaces two by two. Names, numbers and file names
    are no evidence."""
    if not sentence.isascii():
        runs = _NON_LATIN.findall(sentence)
        if runs:
            most = Counter(script(r[0]) for r in runs for _ in r).most_common(1)[0][0]
            own = [r for r in runs if script(r[0]) == most]
            letters = sum(map(len, own))
            latin = sum(map(len, _LOWER.findall(sentence)))
            if letters * (3 if most in "ct" else 1) > latin:
                return " ".join(own)
    return " ".join(_LOWER.findall(sentence) + _ELISION.findall(sentence))


def ngrams(word: str) -> list[str]:
    """N-grams of a word; longer ones take in its edges."""
    p = f"_{word}_"
    n = len(p)
    return [p[i : i + k] for k in range(1, LONGEST + 1) for i in range(n - k + 1) if k > 1 or p[i] != "_"]


class Profiles:
    """Profiles as one table: a row for each language, a column for each n-gram
    some profile holds."""

    def __init__(self, ranks: dict[str, dict[str, int]]):
        self.languages = [x for x in LANGUAGES if ranks.get(x)]
        found = {g for x in self.languages for g in ranks[x]}
        # Equally frequent n-grams of a sentence go by their place in all profiles.
        order = sorted(found, key=lambda g: (sum(ranks[x].get(g, PROFILE) for x in self.languages), g))
        self.ids = {g: i for i, g in enumerate(order)}
        self.ranks = np.full((len(self.languages), len(order) + 1), _ABSENT, dtype=np.int16)
        for j, x in enumerate(self.languages):
            for g, r in ranks[x].items():
                self.ranks[j, self.ids[g]] = r
        self.words: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"words": {}}

    def _word(self, word: str) -> np.ndarray:
        """The n-grams of a word as numbers; those of no profile come after all others."""
        known = len(self.ids)
        found = np.array([i if (i := self.ids.get(g)) is not None else known + zlib.crc32(g.encode()) % (1 << 22) for g in ngrams(word)], dtype=np.int32)
        if len(self.words) > 300_000:
            self.words.clear()
        self.words[word] = found
        return found

    def distances(self, evidence: list[list[str]], among: list[int] | None = None) -> np.ndarray:
        """Mean out-of-place distance of each text, given as its words, to each
        language (or some): how far, n-gram by n-gram, its own ranking is from the
        profile's; what a profile lacks is ``PROFILE`` places off."""
        get = self.words.get
        among = list(range(len(self.languages))) if among is None else among
        if not evidence or not among:
            return np.zeros((len(evidence), len(among)))
        parts = [w if (w := get(x)) is not None else self._word(x) for e in evidence for x in e]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        texts = np.repeat(np.arange(len(evidence)), [len(e) for e in evidence])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        key = np.sort((np.repeat(texts, sizes) << 24) | flat)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.minimum(np.diff(np.append(new, len(key))), 4095)
        gram, text = key[new] & 0xFFFFFF, key[new] >> 24
        ranked = np.sort((text << 36) | ((4095 - count) << 24) | gram)
        text, gram = ranked >> 36, ranked & 0xFFFFFF
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
        rank = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
        near = rank < OWN
        text, gram, rank = text[near], gram[near], rank[near].astype(np.int16)
        out = np.full((len(evidence), len(among)), float(PROFILE))
        if len(text):
            gram = np.minimum(gram, len(self.ids))
            first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            size = np.diff(np.append(first, len(text)))
            for j, i in enumerate(among):
                apart = self.ranks[i].take(gram)
                apart -= rank
                np.abs(apart, out=apart)
                np.minimum(apart, PROFILE, out=apart)
                out[text[first], j] = np.add.reduceat(apart, first, dtype=np.int32) / size
        return out

    def name(self, found: list[str]) -> list[tuple[str, float, str]]:
        """Language and confidence of each sentence, empty without evidence, and the
        next language if that is as likely. The confidence is the share by which
        the next language is farther off."""
        evidence = [skeleton(x) for x in found]
        return self.name_evidence(evidence)

    def name_evidence(self, evidence: list[str]) -> list[tuple[str, float, str]]:
        """The same of evidence. What is all Latin is compared with the languages
        of that script, anything else with all."""
        out: list[tuple[str, float, str]] = [("", 0.0, "")] * len(evidence)
        latin = [i for i, x in enumerate(self.languages) if _SCRIPT_OF[x] == "l"]
        for among, plain in ((latin, True), (list(range(len(self.languages))), False)):
            mine = [k for k, e in enumerate(evidence) if e and (e.isascii() or script(max(e)) == "l") == plain]
            at = 0
            while at < len(mine):
                part, letters = [], 0
                while at < len(mine) and (letters < 200_000 or not part):
                    part.append(mine[at])
                    letters += len(evidence[mine[at]])
                    at += 1
                self._name(evidence, part, among, out)
        return out

    def _name(self, evidence: list[str], part: list[int], among: list[int], out: list) -> None:
        d = self.distances([evidence[k].split() for k in part], among)
        if d.shape[1] < 2:
            for k in part:
                out[k] = (self.languages[among[0]], 1.0, "") if among else ("", 0.0, "")
            return
        two = np.argpartition(d, 1, axis=1)[:, :2]
        two = np.where(np.take_along_axis(d, two[:, :1], 1) <= np.take_along_axis(d, two[:, 1:], 1), two, two[:, ::-1])
        best, next_ = np.take_along_axis(d, two, 1).T
        margin = (next_ - best) / np.maximum(1e-9, next_)
        for k, (i, j), c, b in zip(part, two.tolist(), margin.tolist(), best.tolist()):
            if b < PROFILE:
                close = c < MARGIN + SHORT / (1 + evidence[k].count(" ")) ** 2
                out[k] = (self.languages[among[i]], c, self.languages[among[j]] if close else "")


def sentences(text: str | None) -> Iterator[str]:
    """Whole sentences of the running text: no headings, items, tables, code or
    lines without an end."""
    if not text:
        return
    if _ANY.search(text):
        blocks = [b for k, b in analyse(text).blocks if k == "text"]
    else:
        blocks = _BLANK.split(text)
    for block in blocks:
        block = " ".join(block.split())
        if not block:
            continue
        at = 0
        for m in _SENTENCE.finditer(block):
            if m.end() - at >= 12 or script(block[at]) != "l":
                yield block[at : m.end()]
                at = m.end()
        rest = block[at:].strip()
        if not rest:
            continue
        if _TERMINAL.search(rest[-12:]):
            yield rest
        elif thai := sum(map(len, re.findall(r"[฀-๿]+", rest))):
            # Thai has no full stop: spaces part clauses, and a lone short phrase is a heading.
            if " " in rest or at or thai >= 38:
                yield from (c for c in re.split(r"(?<=[฀-๿0-9]) | (?=[฀-๿])", rest) if c.strip())


def segments(named: list[tuple[str, float, str]]) -> list[tuple[str, float, int]]:
    """Segments ``(language, confidence, sentences)`` in order: runs of a text's
    sentences in one language. A sentence almost as close to another language
    counts as being in the text's main one if that has its script."""
    named = [x for x in named if x[0]]
    if not named:
        return []
    weight: Counter = Counter()
    for x, c, _ in named:
        weight[x] += c + 0.02
    main = weight.most_common(1)[0][0]
    out: list[list] = []
    for x, c, other in named:
        if x != main and other and _SCRIPT_OF[x] == _SCRIPT_OF[main]:
            x = main
        if out and out[-1][0] == x:
            out[-1][1] += c
            out[-1][2] += 1
        else:
            out.append([x, c, 1])
    return [(x, min(1.0, c / n / 0.3), n) for x, c, n in out]


def analyse_languages(texts: list[str | None], profiles: Profiles) -> list[list[tuple[str, float, int]]]:
    """The segments of each text."""
    found = [list(sentences(x)) for x in texts]
    named = profiles.name([s for x in found for s in x])
    out, at = [], 0
    for x in found:
        out.append(segments(named[at : at + len(x)]))
        at += len(x)
    return out


def normalised(label: Column) -> Column:
    """A label's language: 'en' of 'EN', 'en-GB', 'en_US'; null of null and empty ones."""
    return F.nullif(F.regexp_extract(F.lower(label), r"^\s*([a-z]+)", 1), F.lit(""))


def learn(labelled: DataFrame, text: str, label: str, key: str) -> Profiles:
    """Profiles from at most ``SAMPLE_DOCS`` texts a label, the first by a hash of
    their key, and at most ``SAMPLE_SENTENCES`` sentences of each, the first by a
    hash of their letters wherever they stand."""
    d = labelled.select(F.xxhash64(F.col(f"`{key}`").cast("string")).alias("h"), normalised(F.col(f"`{label}`")).alias("lang"), F.col(f"`{text}`").alias("body"))
    d = d.filter(F.col("lang").isin(*LANGUAGES) & F.col("body").isNotNull())
    few = d.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("n") <= SAMPLE_DOCS).select("lang", "body")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_batches(batches, "body"):
            rows = []
            for lang, body in zip(b.column("lang").to_pylist(), b.column("body").to_pylist()):
                found = {k for s in sentences(body) if 8 <= len(k := skeleton(s)) <= 4000}
                rows += [(lang, k) for k in sorted(found, key=lambda k: zlib.crc32(k.encode()))[:SAMPLE_SENTENCES]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["lang", "evidence"])

    rows = sorted((r.lang, r.evidence) for r in few.mapInArrow(read, "lang string, evidence string").collect())
    rows = [(lang, e) for lang, e in rows if _SCRIPT_OF[lang] == script(next((c for c in e if c > "\u02af"), e[0]))]
    grams = [Counter(g for w in e.split() for g in ngrams(w)) for _, e in rows]
    profiles = Profiles({})
    for turn in range(4):
        counts: dict[str, Counter] = {x: Counter() for x in LANGUAGES}
        named = profiles.name_evidence([e for _, e in rows]) if turn else []
        for k, ((lang, _), g) in enumerate(zip(rows, grams)):
            if not turn or named[k][0] == lang:
                counts[lang].update(g)
        profiles = Profiles({x: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda y: (-y[1], y[0]))[:PROFILE])} for x, c in counts.items() if c})
    return profiles


def name_languages(df: DataFrame, key: list[str], text: str, label: str, profiles: Profiles) -> DataFrame:
    """``(*key, label, segment_no, lang, confidence, sentences)``, a row for each
    segment. Null and empty texts and texts without a whole sentence give no row;
    repeated rows give repeated rows; further columns are ignored."""
    names = [f"k{i}" for i in range(len(key))]
    d = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(key, names)], normalised(F.col(f"`{label}`")).alias("label"), F.col(f"`{text}`").alias("body")).filter("body is not null")
    kinds = dict(d.dtypes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_batches(batches, "body"):
            index, rows = [], []
            for i, found in enumerate(analyse_languages(b.column("body").to_pylist(), profiles)):
                index += [i] * len(found)
                rows += [(k, *r) for k, r in enumerate(found, 1)]
            if rows:
                at = pa.array(index, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(n).take(at) for n in (*names, "label")), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.int32())],
                    names=[*names, "label", "segment_no", "lang", "confidence", "sentences"],
                )

    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "label string, segment_no int, lang string, confidence double, sentences int"])
    return d.mapInArrow(scan, schema).withColumnsRenamed(dict(zip(names, key)))


def _named(spark: SparkSession, base: str) -> DataFrame:
    d = documents(spark, base, F.col("lang").alias("label"))
    c = chunks(spark, base, F.get_json_object("metadata", "$.language").alias("label"))
    return name_languages(d.unionByName(c), ["src", "rec_id"], "text", "label", learn(d, "text", "label", "rec_id"))


def segments_query(spark: SparkSession, base: str) -> DataFrame:
    return _named(spark, base)


def found_query(spark: SparkSession, base: str) -> DataFrame:
    """Records whose label is missing, of another language than the text, or one of several."""
    n = _named(spark, base).groupBy("src", "rec_id", F.coalesce("label", F.lit("")).alias("label")).agg(F.collect_set("lang").alias("langs"))
    wrong = (F.col("label") == "") | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label"))
    return n.filter(wrong).select("src", "rec_id", F.explode("langs").alias("lang")).distinct()

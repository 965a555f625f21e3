"""Problem 10: sentence boundaries by a hidden-event language model.

Between the tokens of a text lie slots where a boundary event may stand: after
closing punctuation, in scripts without it at spaces, and in a stretch without
any such mark between all its words (or characters). The model gives the
probability of the token before the slot, the punctuation and the token after
it, with and without the event, and of a boundary so many words after another.
It is trained without labels: the ends and beginnings of paragraphs show what
stands around boundaries, words inside clauses what doesn't, and
expectation-maximisation over the slots of the whole table does the rest. A
text's slots are then decided together by forward-backward posteriors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import cut_batches, materialize, read_table, spread

#: Words and contexts rarer than this share of all words are known by their shape only, so that the model has at most 1 / share of each a table.
WORD_SHARE = 2e-6
#: Tokens from which a stretch without any mark is taken for unpunctuated sentences; a shorter one is a heading.
UNMARKED = 40
#: Words between two slots that have a transition of their own; more count as these.
GAPS = 6
#: Posterior from which a slot is a boundary.
DECIDE = 0.5

_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_CLOSE = "\"'»”’)\\]」』）】》"
_OPEN = "\"'«“„‘([¿¡「『（【《‹"
_THAI = "ก-๛"
_CJK = "ぁ-ヿ㐀-鿿"
_SLOT = re.compile(
    rf"[.!?…]+(?:[{_CLOSE}]|[   ]»)*(?=\s)"  # followed by space
    rf"|(?:[。！？।]|……)+[{_CLOSE}]*\s*(?=\S)"  # ends by itself
    rf"|(?<=[^\W\d_])[.!?…]+[{_CLOSE}]*(?=[“「{_CJK}])"
    rf"|(?<=[^\W_A-Z*])[.!?]+[)»”]*(?=[A-ZÀ-ÞА-Я][^\W\d_A-Z]*\b(?![.]\w|[_-]))"  # a space was lost
    rf"|(?<=[)»”])[.!?]+(?=[A-ZÀ-ÞА-Я])"
    rf"|(?<=[{_THAI}])[^\S\n]+(?=\S)|(?<=\S)[^\S\n]+(?=[{_THAI}])"
)
_BEFORE = re.compile(r"[^\s" + re.escape("\"'’«“„‘(「『（") + r"]*$")
_AFTER = re.compile(rf"\s*(?P<o>[{re.escape(_OPEN)}]*)\s?(?P<w>[{_CJK}{_THAI}]{{1,2}}|[^\W_]+(?:[-.'’][^\W_]+)*|\S|$)")
_MID = re.compile(rf"(?<=[^\W\d_]) ([^\W_]+(?:[-.'’][^\W_]+)*)")
_TOKEN = re.compile(rf"[{_CJK}{_THAI}]|[^\W_]+(?:[-.'’][^\W_]+)*")
_CJK_RUN = re.compile(rf"[{_CJK}{_THAI}]{{2,}}")
_LAST = re.compile(rf"([{_CJK}]{{1,2}}|[^\W_]+(?:[-.'’][^\W_]+)*)[^\w]*$")


def _shape(w: str) -> str:
    if not w:
        return "<end>"
    c = w[0]
    if c.isdigit():
        return "<9>"
    if "฀" <= c <= "๿" or "぀" <= c <= "鿿":
        return "<c>"
    if c.isupper():
        return "<Aa>" if any(x.islower() for x in w) else "<A>"
    if c.islower():
        return "<a>"
    return "<o>" if c.isalpha() else "<p>" + c


def script(text: str, a: int, at: int) -> str:
    """The script of the last letter before a position: what begins a sentence
    in one is common inside clauses in another."""
    for i in range(at - 1, max(a, at - 40) - 1, -1):
        c = text[i]
        if c > "\u02af":
            found = "y" if "\u0370" <= c < "\u0530" else "d" if "\u0900" <= c < "\u0980" else "t" if "\u0e00" <= c < "\u0e80" else "c" if "\u3041" <= c <= "\u9fff" else "o" if c.isalpha() else ""
            if found:
                return found
        if c.isalpha():
            return "l"
    return "l"


def left(text: str, at: int) -> str:
    """The token before a mark: short ones as they are, others by shape."""
    w = _BEFORE.search(text, max(0, at - 24), at).group()
    if not w:
        return "<none>"
    c = w[-1]
    if c.isdigit():
        return "<9>"
    if "฀" <= c <= "๿" or "぀" <= c <= "鿿":
        return "<c>"
    if len(w) <= 6 and w[0].isalpha() and (len(w) <= 4 or "." in w):
        return w
    return "<w>" if c.isalpha() else "<s>"


def right(text: str, at: int) -> tuple[str, str]:
    """The token after a slot and whether a quotation or bracket opens before it."""
    m = _AFTER.match(text, at)
    return m.group("w"), "q" if m.group("o") else ""


def mark(m: str) -> str:
    """Punctuation of a slot: its kind and whether it closes something."""
    bare = m.strip()
    if not bare:
        return "_"
    kind = "…" if "…" in bare or ".." in bare else next((c for c in bare if c in "!?！？。।"), ".")
    return ("?" if kind in "?!！？" else kind) + ("" if bare[-1] in ".!?…。！？।" else ")" if bare[-1] in ")]）" else '"') + ("" if m[-1:].isspace() or kind in "。।？！…" else "")


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each stretch between blank lines, without outer space."""
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        a, b = at, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            yield a, b
        at = m.end() if m else end


def slots(text: str, a: int, b: int) -> list[tuple[int, str, str, str, str]]:
    """``(end, left, mark, right, opens)`` of a paragraph's inner slots."""
    out = []
    for m in _SLOT.finditer(text, a, b):
        body = m.group()
        bare = body.rstrip()
        end = m.start() + len(bare)
        if end >= b:
            break
        r, q = right(text, m.end())
        out.append((end, left(text, m.start()), mark(bare), script(text, a, m.start()) + r, q))
    return out


def _count(text: str, to: Counter) -> None:
    for a, b in paragraphs(text):
        found = slots(text, a, b)
        tail = re.search(rf"[.!?…。！？।]+[{_CLOSE}]*$", text[max(a, b - 12) : b])
        thai = "฀" <= text[b - 1] <= "๿" or "_" in {x[2] for x in found}
        if not tail and not thai:
            continue  # a heading shows nothing
        first, q = right(text, a)
        side = script(text, a, b)
        to["first", side + first, q, side + _shape(first)] += 1
        if tail and (m := _LAST.search(text, max(a, b - 40), b)):
            to["end", side + m.group(1).lower(), "", side + _shape(m.group(1))] += 1
        if tail:
            to["last", left(text, b - len(tail.group())), mark(tail.group()), ""] += 1
        else:
            to["last", left(text, b), "_", ""] += 1
        for _, x, m, r, o in found:
            to["slot", f"{x}\t{m}", r + "\t" + o, r[0] + _shape(r[1:])] += 1
        part = text[a:b]
        for m in _MID.finditer(part):
            w, side = m.group(1), script(part, 0, m.start())
            to["mid", side + w, "", side + _shape(w)] += 1
        for run in _CJK_RUN.findall(part):
            for i in range(1, len(run) - 1):
                side = "t" if run[i - 1] < "\u3000" else "c"
                to["mid", side + run[i : i + 2], "", side + "<c>"] += 1


class Model:
    """Probabilities with and without the event, in logarithms of their ratio."""

    def __init__(self, rows: list[tuple[str, str, str, str, int]], rounds: int = 6):
        first: Counter = Counter()
        mid: Counter = Counter()
        last: Counter = Counter()
        slot: Counter = Counter()
        end: Counter = Counter()
        for kind, x, y, shape, n in rows:
            if kind == "first":
                first[x + "\t" + y] += n
            elif kind == "mid":
                mid[x] += n
            elif kind == "last":
                last[x, y] += n
            elif kind == "end":
                end[x] += n
            else:
                l, m = x.split("\t")
                slot[l, m, y] += n
        self.known = set(mid) | {x.split("\t")[0] for x in first}
        self.turn = [1.0] * (GAPS + 1)
        self._fit(first, mid, last, slot, rounds)
        self._words(first, mid, end, slot)

    def _words(self, first: Counter, mid: Counter, end: Counter, slot: Counter) -> None:
        """What speaks for a boundary between two plain words: how much oftener a
        word begins or ends paragraphs than it stands inside clauses, by script,
        whatever its case; and the mean number of words in a sentence."""
        begin, inside = Counter(), Counter()
        for k, n in first.items():
            begin[k.split("\t")[0].lower()] += n
        for k, n in mid.items():
            inside[k.lower()] += n
        tb, te, ti = (sum(c.values()) + 1 for c in (begin, end, inside))
        ratio = lambda c, t: {w: max(-6.0, min(6.0, math.log((c[w] + 0.1) / t / ((inside[w] + 0.1) / ti)))) for w in c | inside}
        self.start, self.stop = ratio(begin, tb), ratio(end, te)
        ends, words = Counter(), Counter()
        for (l, m, r), n in slot.items():
            ends[r[0]] += n / (1 + math.exp(-max(-40.0, min(40.0, self.score(l, m, *r.split("\t"))))))
        for c, by in ((first, ends), (mid, words)):
            for k, n in c.items():
                by[k[0]] += n
        self.length = {side: max(3.0, words[side] / max(1.0, ends[side])) for side in ends}

    def learn_turns(self, pairs: dict[int, tuple[float, float]]) -> None:
        """Transitions out of expected numbers: how often a boundary so many words
        before is followed by one, against the distance where that is commonest."""
        rate = {g: (a + 1) / (a + b + 2) for g, (a, b) in pairs.items()}
        best = max(rate.values(), default=1.0)
        self.turn = [max(0.02, rate.get(g, best) / best) for g in range(GAPS)] + [1.0]

    def between_words(self, text: str, a: int, b: int) -> list[int]:
        """Boundaries in a stretch without marks: forward-backward over sentences
        of all lengths, likely ones being near the mean."""
        tokens = list(_TOKEN.finditer(text, a, b))
        if len(tokens) < UNMARKED:
            return []
        side = script(text, a, b)
        cjk = side in "ct"
        # In scripts without spaces two characters on either side speak.
        name = lambda i, back: side + (text[tokens[i].start() : tokens[i].start() + 2] if cjk and not back else text[max(a, tokens[i].end() - 2) : tokens[i].end()] if cjk else tokens[i].group()).lower()
        n, mean = len(tokens), self.length.get(side, 20.0)
        longest = int(3 * mean) + 1
        weight = [0.0] + [(k / mean) ** 2 * math.exp(-3 * k / mean) for k in range(1, longest + 1)]
        score = [1.0] + [math.exp(max(-8.0, min(8.0, self.start.get(name(i, False), -1.0) + self.stop.get(name(i - 1, True), -1.0)))) for i in range(1, n)] + [1.0]
        ahead, scale = [1.0] + [0.0] * n, [1.0] * (n + 1)
        for i in range(1, n + 1):
            s, f = 0.0, 1.0
            for k in range(1, min(longest, i) + 1):
                s += ahead[i - k] * weight[k] * f
                f /= scale[i - k]
            ahead[i] = s * score[i]
            scale[i] = ahead[i] if ahead[i] > 0 else 1.0
            ahead[i] = 1.0 if ahead[i] > 0 else 0.0
        back = [0.0] * n + [1.0]
        for i in range(n - 1, -1, -1):
            s, f = 0.0, 1.0
            for k in range(1, min(longest, n - i) + 1):
                f /= scale[i + k]
                s += back[i + k] * weight[k] * score[i + k] * f
            back[i] = s
        total = back[0] or 1.0
        return [tokens[i - 1].end() for i in range(1, n) if ahead[i] * back[i] / total >= DECIDE]

    def _fit(self, first: Counter, mid: Counter, last: Counter, slot: Counter, rounds: int) -> None:
        times, ends, marks = Counter(), Counter(), Counter()
        for (l, m, _), n in slot.items():
            times[l, m] += n
            marks[m] += n
        for (_, m), n in last.items():
            ends[m] += n
        share = 0.2  # of boundaries that end a paragraph
        right = Counter(first)
        mids = sum(mid.values()) or 1
        apart = Counter({w + "\t": n for w, n in mid.items()})
        weight = sum(slot.values()) / mids / 10
        no_r = Counter({w: n * weight for w, n in apart.items()})
        for _ in range(rounds):
            self._left(times, last, ends, marks, share)
            self._right(right, no_r)
            right, no_r, yes = Counter(first), Counter({w: n * weight for w, n in apart.items()}), 0.0
            for (l, m, r), n in slot.items():
                p = 1 / (1 + math.exp(-max(-40.0, min(40.0, self.score(l, m, *r.split("\t"))))))
                right[r] += n * p
                no_r[r] += n * (1 - p)
                yes += n * p
            share = min(0.5, sum(ends.values()) / max(1.0, sum(ends.values()) + yes))
        self._left(times, last, ends, marks, share)
        self._right(right, no_r)

    def _left(self, times: Counter, last: Counter, ends: Counter, marks: Counter, share: float) -> None:
        """Odds of a boundary after a token and mark: a token that ends sentences
        ends paragraphs as well, in the same share as all boundaries."""
        self.l, self.m = {}, {}
        for m in marks | ends:
            yes = min(marks[m] + 1.0, ends[m] * (1 - share) / share)
            self.m[m] = (yes + 4.0) / (marks[m] - yes + 2.0)
        for (l, m), n in times.items():
            p = self.m[m] / (1 + self.m[m])
            yes = min(float(n), last[l, m] * (1 - share) / share)
            self.l[l, m] = math.log((yes + 2 * p) / (n - yes + 2 * (1 - p)))
        self.m = {m: math.log(x) for m, x in self.m.items()}

    def _right(self, yes: Counter, no: Counter) -> None:
        self.r = {}
        ty, tn = sum(yes.values()) + 1, sum(no.values()) + 1
        for k in yes | no:
            self.r[k] = math.log(((yes[k] + 0.05) / ty) / ((no[k] + 0.05) / tn))

    def score(self, l: str, m: str, r: str, q: str) -> float:
        """Log odds of a boundary in a slot by itself."""
        if r[1:2] in ",;:)" and r[1:]:
            return -20.0
        x = self.l.get((l, m))
        if x is None:
            x = self.m.get(m, 0.0)
        y = self.r.get(f"{r}\t{q}")
        if y is None:
            y = self.r.get(f"{r}\t")
        return x + max(-6.0, min(6.0, y or 0.0))

    def chain(self, text: str, a: int, b: int) -> tuple[list[int], list[float], list[int]]:
        """Ends, log odds and distances of a paragraph's slots."""
        ends, odds, gaps, at = [], [], [], a
        for end, l, m, r, q in slots(text, a, b):
            ends.append(end)
            odds.append(self.score(l, m, r if r in self.known else r[0] + _shape(r[1:]), q))
            gaps.append(min(GAPS, text.count(" ", at, end) + (end - at) // 12))
            at = end
        return ends, odds, gaps

    def decide(self, text: str) -> list[int]:
        """Ends of the sentences of a text."""
        ends = []
        for a, b in paragraphs(text):
            found, odds, gaps = self.chain(text, a, b)
            if found:
                ends += [e for e, p in zip(found, posteriors(odds, [self.turn[g] for g in gaps])[0]) if p >= DECIDE]
            elif b - a >= UNMARKED:
                ends += self.between_words(text, a, b)
            ends.append(b)
        return ends


def posteriors(odds: list[float], turn: list[float]) -> tuple[list[float], list[tuple[float, float]]]:
    """Forward-backward over a chain of slots. ``turn`` weighs a boundary that
    follows the one before it. Gives the probability of each boundary and, for
    each slot, those of a boundary before it with and without one here."""
    emit = [(1 / (1 + math.exp(max(-40.0, min(40.0, -x)))), 1 / (1 + math.exp(max(-40.0, min(40.0, x))))) for x in odds]
    fy, fn, ahead = 1.0, 0.0, []
    for (y, n), w in zip(emit, turn):
        fy, fn = y * (fy * w + fn), n * (fy + fn)
        s = fy + fn
        fy, fn = fy / s, fn / s
        ahead.append((fy, fn))
    by, bn, out, pairs = 1.0, 1.0, [], []
    for i in range(len(odds) - 1, -1, -1):
        y, n = ahead[i][0] * by, ahead[i][1] * bn
        out.append(y / (y + n))
        (ey, en), w = (emit[i][0] * by, emit[i][1] * bn), turn[i]
        py, pn = ahead[i - 1] if i else (1.0, 0.0)
        s = py * (ey * w + en) + pn * (ey + en)
        pairs.append((py * ey * w / s, py * en / s))
        by, bn = ey * w + en, ey + en
        s = by + bn
        by, bn = by / s, bn / s
    return out[::-1], pairs[::-1]


def train(df: DataFrame, text: str) -> Model:
    """The model of all texts of a table. What comes to the driver are counts of
    words and contexts above ``WORD_SHARE``, rarer words falling into shapes."""
    d = df.select(F.col(f"`{text}`").alias("body")).filter("body is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_batches(batches, "body", 8_000_000):
            to: Counter = Counter()
            for x in b.column("body").to_pylist():
                _count(x, to)
            keys = list(to)
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(4)), pa.array([to[k] for k in keys], pa.int64())], names=["kind", "x", "y", "shape", "n"])

    c = materialize(d.mapInArrow(count, "kind string, x string, y string, shape string, n bigint").groupBy("kind", "x", "y", "shape").agg(F.sum("n").alias("n")), "counts")
    total = c.filter("kind = 'mid'").agg(F.sum("n")).first()[0] or 0
    least = max(2, math.ceil(total * WORD_SHARE))
    words = c.filter("kind in ('first', 'mid')").groupBy(F.col("x").alias("w")).agg(F.sum("n").alias("all")).filter(F.col("all") >= least).select("w", F.lit(1).alias("frequent"))
    word = F.when(F.col("kind") == "slot", F.substring_index("y", "\t", 1)).when(F.col("kind") == "last", F.lit(None)).otherwise(F.col("x"))
    j = c.withColumn("w", word).join(words, "w", "left")
    rare = F.col("frequent").isNull()
    j = j.withColumn("y", F.when((F.col("kind") == "slot") & rare, F.concat("shape", F.lit("\t"), F.substring_index("y", "\t", -1))).otherwise(F.col("y")))
    j = j.withColumn("x", F.when(F.col("kind").isin("first", "mid", "end") & rare, F.col("shape")).otherwise(F.col("x")))
    # A token before a mark that is seen too seldom is a word like any other.
    short = F.when(F.col("kind") == "slot", F.substring_index("x", "\t", 1)).when(F.col("kind") == "last", F.col("x"))
    j = j.withColumn("short", short)
    tokens = j.filter("short is not null and short not like '<%'").groupBy("short").agg(F.sum("n").alias("all")).filter(F.col("all") >= least).select("short", F.lit(1).alias("known"))
    j = j.join(tokens, "short", "left")
    plain = F.col("known").isNull() & ~F.col("short").startswith("<")
    j = j.withColumn("x", F.when((F.col("kind") == "slot") & plain, F.concat(F.lit("<w>\t"), F.substring_index("x", "\t", -1))).when((F.col("kind") == "last") & plain, F.lit("<w>")).otherwise(F.col("x")))
    # A token, mark and word that seldom meet leave the word's shape.
    seen = j.groupBy("kind", "x", "y", F.when(F.col("kind") == "slot", F.col("shape")).alias("shape")).agg(F.sum("n").alias("n"))
    seldom = (F.col("kind") == "slot") & (F.col("n") < math.ceil(total * WORD_SHARE / 10))
    seen = seen.withColumn("y", F.when(seldom, F.concat("shape", F.lit("\t"), F.substring_index("y", "\t", -1))).otherwise(F.col("y"))).groupBy("kind", "x", "y").agg(F.sum("n").alias("n"))
    model = Model([(r.kind, r.x, r.y, "", r.n) for r in seen.collect()])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0.0, 0.0] for _ in range(GAPS + 1)]
        for b in cut_batches(batches, "body", 8_000_000):
            for x in b.column("body").to_pylist():
                for p, q in paragraphs(x):
                    _, odds, gaps = model.chain(x, p, q)
                    if odds:
                        for g, (yes, no) in zip(gaps, posteriors(odds, [1.0] * len(odds))[1]):
                            sums[g][0] += yes
                            sums[g][1] += no
        yield pa.RecordBatch.from_arrays([pa.array(range(GAPS + 1), pa.int32()), *(pa.array([s[i] for s in sums]) for i in range(2))], names=["g", "yes", "no"])

    model.learn_turns({r.g: (r.yes, r.no) for r in d.mapInArrow(turns, "g int, yes double, no double").groupBy("g").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()})
    return model


def split_sentences(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """``(item, sentence_no, start_pos, end_pos)`` in code points.

    A sentence's end takes in closing quotes and brackets but no white space. A
    blank line always ends one, and a heading is one unit. Null texts and texts
    of white space give no row; repeated rows give repeated rows; further
    columns are ignored.
    """
    d = df.select(F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").alias("body")).filter("body is not null")
    kind = dict(d.dtypes)["item"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_batches(batches, "body"):
            index, no, starts, ends = [], [], [], []
            for i, x in enumerate(b.column("body").to_pylist()):
                at = 0
                for k, e in enumerate(model.decide(x), 1):
                    while x[at].isspace():
                        at += 1
                    index.append(i)
                    no.append(k)
                    starts.append(at)
                    ends.append(e)
                    at = e
            yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(index, pa.int32())), pa.array(no, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["item", "sentence_no", "start_pos", "end_pos"])

    return d.mapInArrow(cut, f"item {kind}, sentence_no int, start_pos int, end_pos int")


def found_query(spark: SparkSession, base: str) -> DataFrame:
    d = spread(read_table(spark, base, "documents").filter("source = 'archive'").select("doc_id", "text"))
    s = split_sentences(d, "doc_id", "text", train(d, "text"))
    return s.select(F.col("item").alias("doc_id"), "end_pos").distinct()


def units_query(spark: SparkSession, base: str) -> DataFrame:
    """Sentence units of every document; the model learns from all of them."""
    d = spread(read_table(spark, base, "documents").select("doc_id", "text"))
    return split_sentences(d, "doc_id", "text", train(d, "text")).withColumnRenamed("item", "doc_id")

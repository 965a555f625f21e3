"""Whether an answer holds: grounding in its sources, consistency, completeness,
numbers that no source has, and a verdict from all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvine.functions.columns import whitespace_tokens

# Words that say nothing of the content, and patterns of answers.
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "to", "of", "in",
    "on", "at", "by", "for", "with", "from", "as", "and", "or", "but", "if", "then", "than", "that", "this", "these", "those",
]
CONTRADICTION = [r"\bhowever\b.*?\bbut\b", r"\balthough\b.*?\bactually\b", r"\bdespite\b.*?\bin fact\b", r"\bcontrary to\b"]
INCOMPLETE = [r"^i don't know", r"^i cannot", r"^i'm not sure", r"^there is no information", r"^the context does not"]
BOTH_SIDES = r"\b(both|and|versus|compared to)\b"
NUMBER = r"\b\d+(?:\.\d+)?%?"

# Weights and limits of the verdict.
GROUNDING_PARTS, CONFIDENCE_PARTS = (0.4, 0.6), (0.45, 0.35, 0.20)
CRITICAL_PENALTY, MOST_PENALTY, THRESHOLD = 0.15, 0.3, 0.7


def _any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def verify(query_kind: Column, answer: Column, sources: Column, semantic: Column | None = None, threshold: float = THRESHOLD) -> Column:
    """Struct of the scores, the ``issues``, the ``status`` and whether to
    ``present`` an answer.

    ``sources`` is the text of all sources and ``semantic`` a likeness of answer
    and sources from an encoder (0 without one). A null answer or source counts
    as empty.
    """
    answer, sources = F.coalesce(answer, F.lit("")), F.coalesce(sources, F.lit(""))
    low = F.lower(answer)
    stop = F.array(*map(F.lit, STOP_WORDS))
    content = lambda c: F.array_except(F.array_distinct(whitespace_tokens(c)), stop)
    own = content(answer)
    overlap = F.when(F.size(own) > 0, F.size(F.array_intersect(own, content(sources))) / F.size(own)).otherwise(0.0)
    grounding = GROUNDING_PARTS[0] * overlap + GROUNDING_PARTS[1] * (F.lit(0.0) if semantic is None else F.coalesce(semantic, F.lit(0.0)))
    consistency = F.when(_any(low, CONTRADICTION), 0.5).otherwise(0.9)
    words = F.size(whitespace_tokens(answer))
    short, unknown = words < 5, _any(low, INCOMPLETE)
    one_side = (query_kind == "comparative") & ~low.rlike(BOTH_SIDES)
    brief = (query_kind == "multi_hop") & (words < 20)
    completeness = F.when(short, 0.4).when(unknown, 0.3).when(F.coalesce(one_side, F.lit(False)), 0.6).when(F.coalesce(brief, F.lit(False)), 0.7).otherwise(0.8)
    numbers = F.regexp_extract_all(answer, F.lit(f"({NUMBER})"), 1)
    foreign = F.filter(numbers, lambda n: ~F.contains(sources, n))
    invented = (F.size(numbers) > 0) & (F.size(foreign) > 0.5 * F.size(numbers))
    weak = grounding < 0.4
    critical = F.when(weak, 1).otherwise(0) + F.when(invented, 1).otherwise(0)
    base = CONFIDENCE_PARTS[0] * grounding + CONFIDENCE_PARTS[1] * consistency + CONFIDENCE_PARTS[2] * completeness
    confidence = F.greatest(F.lit(0.0), base - F.least(F.lit(MOST_PENALTY), critical * CRITICAL_PENALTY))
    status = F.when(invented, "hallucination").when(consistency < 0.5, "contradictory").when((confidence >= 0.8) & (grounding >= 0.7), "verified").when(confidence >= 0.6, "likely_correct").otherwise("uncertain")
    present = F.when(invented | (consistency < 0.5), False).when(confidence >= threshold, True).when(critical > 0, False).otherwise(confidence >= 0.4)
    issue = lambda when, name: F.when(when, F.lit(name))
    issues = F.filter(
        F.array(issue(weak, "unsupported:critical"), issue(~weak & (grounding < 0.6), "unsupported:moderate"), issue(short | unknown, "incomplete:moderate"), issue(~short & ~unknown & (completeness < 0.8), "incomplete:minor"), issue(invented, "hallucination:critical")),
        lambda x: x.isNotNull(),
    )
    return F.struct(grounding.alias("grounding"), consistency.alias("consistency"), completeness.alias("completeness"), confidence.alias("confidence"), issues.alias("issues"), status.alias("status"), present.alias("present"))

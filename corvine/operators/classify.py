"""Kinds of queries and what to do about each: eleven kinds told by patterns,
entities and markers taken out of the text, a retrieval strategy for each kind."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of each kind, in the order in which equal scores are settled.
PATTERNS: dict[str, list[str]] = {
    "factoid": [r"^(what|who|when|where|which)\s+(is|are|was|were)\b", r"^define\b", r"^list\s+the\s+(definition|meaning)", r"\?$"],
    "analytical": [r"\b(why|how\s+does|explain|analyze|analysis)\b", r"\b(reason|cause|effect|impact|consequence)\b", r"\b(relationship|correlation|connection)\b"],
    "comparative": [r"\b(compare|comparison|versus|vs\.?|differ|difference|between)\b", r"\b(better|worse|more|less)\s+than\b", r"\b(similar|different|contrast)\b", r"\bx\s+vs\s+y\b"],
    "procedural": [r"^how\s+(to|do|can|should|would)\b", r"\b(steps?|process|procedure|instructions?|guide)\b", r"\b(tutorial|walkthrough|implement)\b"],
    "navigational": [r"\b(find|show|locate|where.*section|which.*part)\b", r"\b(documentation|docs?)\s+(for|on|about)\b", r"\b(page|section|chapter)\s+\d+\b"],
    "aggregative": [r"\b(all|every|summarize|list|overview)\b", r"\b(instances?|occurrences?|mentions?)\s+of\b", r"\b(total|count|number)\s+of\b"],
    "exact_match": [r"\b[A-Z]{2,}-\d+\b", r"#\d+", r"\b\d{4,}\b", r"""["'].+["']""", r"\b[A-Z0-9]{8,}\b"],
    "temporal": [
        r"\b(latest|recent|newest|current|today|yesterday|tomorrow)\b", r"\b(20\d{2}|19\d{2})\b", r"\b(q[1-4]|quarter\s+[1-4])\b",
        r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\b", r"\b(last|past|previous|next)\s+(year|month|week|day|quarter)\b",
    ],
    "negation": [r"\b(not|no|never|without|excluding?|except)\b", r"\bisn'?t\b", r"\baren'?t\b", r"\bdon'?t\b", r"\bdoesn'?t\b", r"\bnone\s+of\b"],
    "multi_hop": [r"\b(and\s+then|after\s+that|followed\s+by)\b", r"\bof\s+the\s+\w+\s+that\b", r"\b(which|who|what)\s+\w+.*\b(which|who|what)\b"],
    "conversational": [r"^(it|this|that|those|these|they)\b", r"^(yes|no|maybe|ok|okay)\b", r"^(what\s+about|how\s+about)\b", r"^(and|but|however|also)\b"],
}
#: Kinds whose patterns tell capitals from small letters.
CASED = {"exact_match"}

# Further patterns of four kinds by language.
MULTILINGUAL: dict[str, dict[str, list[str]]] = {
    "en": {
        "factoid": [r"\b(what|who|when|where|which)\s+(is|are|was|were)\b", r"\bdefine\b"],
        "comparative": [r"\b(compare|comparison|versus|vs\.?|differ|difference|between)\b", r"\b(better|worse|more|less)\s+than\b"],
        "procedural": [r"\bhow\s+(to|do|can)\b", r"\b(steps?|process|guide|tutorial)\b"],
        "negation": [r"\b(not|no|never|without|excluding?|except)\b", r"\bisn'?t\b"],
    },
    "fr": {
        "factoid": [r"\b(qu'?est-ce que|quel|quelle|qui|quand|où|quoi)\b", r"\b(définir|définition)\b", r"\bc'?est quoi\b"],
        "comparative": [r"\b(comparer|comparaison|différence|entre)\b", r"\b(meilleur|pire|plus|moins)\s+que\b", r"\bpar rapport à\b"],
        "procedural": [r"\bcomment\b", r"\b(étapes?|procédure|processus|guide|tutoriel)\b", r"\bfaire\b.*\bcomment\b"],
        "negation": [r"\b(pas|non|jamais|sans|sauf|excepté)\b", r"\bn'?est\s+pas\b", r"\baucun\b"],
    },
    "de": {
        "factoid": [r"\b(was|wer|wann|wo|welche|welcher|welches)\s+(ist|sind|war|waren)\b", r"\bdefinier\w*\b", r"\bwas bedeutet\b"],
        "comparative": [r"\b(vergleich|unterschied|zwischen)\b", r"\b(besser|schlechter|mehr|weniger)\s+als\b", r"\bgegenüber\b"],
        "procedural": [r"\bwie\b", r"\b(schritte?|prozess|anleitung|tutorial)\b", r"\bmachen\b"],
        "negation": [r"\b(nicht|kein|nie|ohne|ausgenommen)\b", r"\bist\s+nicht\b"],
    },
    "es": {
        "factoid": [r"\b(qué|quién|cuándo|dónde|cuál|cuáles)\s+(es|son|era|eran)\b", r"\bdefinir\b", r"\bqué significa\b"],
        "comparative": [r"\b(comparar|comparación|diferencia|entre)\b", r"\b(mejor|peor|más|menos)\s+que\b", r"\bfrente a\b"],
        "procedural": [r"\bcómo\b", r"\b(pasos?|proceso|guía|tutorial)\b", r"\bhacer\b"],
        "negation": [r"\b(no|nunca|sin|excepto|salvo)\b", r"\bno\s+es\b", r"\bningún\b"],
    },
    "zh": {
        "factoid": ["什么是", "谁是", "什么时候", "哪里", "定义"],
        "comparative": ["比较", "对比", "区别", "差异", "和.*之间"],
        "procedural": ["如何", "怎么", "步骤", "过程", "教程"],
        "negation": ["不是", "没有", "除了", "排除"],
    },
    "ja": {
        "factoid": ["とは", "何ですか", "誰ですか", "いつ", "どこ", "定義"],
        "comparative": ["比較", "違い", "差異", "と.*の間", "より.*ほう"],
        "procedural": ["どのように", "どうやって", "方法", "手順", "チュートリアル"],
        "negation": ["ではない", "ない", "除く"],
    },
}

# Patterns of entities, markers of time, negation and exact terms.
ENTITIES = [
    r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",
    r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Inc|Corp|Ltd|LLC|Company)\b",
    r"\b(?:20\d{2}|19\d{2})[-/]\d{1,2}[-/]\d{1,2}\b",
    r"\b\d+(?:,\d{3})*(?:\.\d+)?\b",
]
TEMPORAL = [
    r"\b(?:20\d{2}|19\d{2})\b",
    r"\b(?:q[1-4]|quarter\s+[1-4])\b",
    r"\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b",
    r"\b(?:latest|recent|current|yesterday|tomorrow|today)\b",
]
NEGATED = [r"\bnot\b", r"\bno\b", r"\bnever\b", r"\bwithout\b", r"\bexcluding?\b", r"\bexcept\b", r"\bisn'?t\b", r"\baren'?t\b", r"\bdon'?t\b", r"\bdoesn'?t\b"]
EXACT = [r"\b[A-Z]{2,}-\d+\b", r"#\d+", r"""["'].+["']""", r"\b[A-Z0-9]{8,}\b"]

# The strategy for each kind and its parameters.
STRATEGIES: dict[str, tuple[str, dict]] = {
    "factoid": ("hybrid", {"alpha": 0.7, "top_k": 20, "use_reranking": True}),
    "analytical": ("vector", {"top_k": 30, "use_reranking": True, "use_mmr": True}),
    "comparative": ("multi_query", {"generate_subqueries": True, "top_k_per_query": 15, "use_mmr": True}),
    "procedural": ("hybrid", {"alpha": 0.6, "top_k": 25, "sequential_ordering": True}),
    "navigational": ("metadata_filter", {"extract_filters": True, "top_k": 10}),
    "aggregative": ("cluster_retrieval", {"cluster_results": True, "top_k": 100, "sample_per_cluster": 3, "use_mmr": True}),
    "exact_match": ("hybrid", {"alpha": 0.3, "top_k": 30, "fallback": "full_text_search"}),
    "temporal": ("vector", {"top_k": 50, "sort_by_date": True}),
    "negation": ("contrastive", {"retrieve_positive": True, "retrieve_negative": True, "filter_negative_from_positive": True}),
    "multi_hop": ("iterative", {"max_hops": 3, "use_graph": True, "use_multi_query": True}),
    "conversational": ("hybrid", {"alpha": 0.8, "top_k": 15, "contextualize_query": True}),
}


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def _hits(q: Column, patterns: list[str], cased: bool) -> Column:
    return reduce(lambda a, b: a + b, [F.when(q.rlike(p if cased else f"(?i){p}"), 1).otherwise(0) for p in patterns])


def classify(q: Column, language: Column | None = None) -> Column:
    """Struct of a query's ``kind`` and ``confidence``: half, and the share of the
    kind's patterns that are found. The highest wins, the first of equals; a
    query without any is a factoid of 0.5. With ``language`` four kinds have that
    language's patterns besides (English for an unknown one). Null gives factoid."""
    scores = []
    for kind, patterns in PATTERNS.items():
        hits, n = _hits(q, patterns, kind in CASED), F.lit(len(patterns))
        if language is not None:
            known = F.when(language.isin(*MULTILINGUAL), language).otherwise("en")
            for code, more in MULTILINGUAL.items():
                if kind in more:
                    hits = hits + F.when(known == code, _hits(q, more[kind], False)).otherwise(0)
                    n = n + F.when(known == code, len(more[kind])).otherwise(0)
        scores.append(F.struct(F.least(F.lit(1.0), hits / n + F.when(hits > 0, 0.5).otherwise(0.0)).alias("score"), F.lit(-len(scores)).alias("place"), F.lit(kind).alias("kind")))
    found = lambda b: F.struct(F.when(b["score"] > 0, b["kind"]).otherwise("factoid").alias("kind"), F.when(b["score"] > 0, b["score"]).otherwise(0.5).alias("confidence"))
    return _let(F.array_max(F.array(*scores)), found)


def _all(q: Column, patterns: list[str], flags: str = "") -> Column:
    return F.concat(*[F.regexp_extract_all(q, F.lit(f"{flags}({p})"), 1) for p in patterns])


def entities(q: Column) -> Column:
    """Names, organisations, dates and numbers, each once, in this order."""
    return F.array_distinct(_all(q, ENTITIES))


def temporal_markers(q: Column) -> Column:
    return _all(q, TEMPORAL, "(?i)")


def has_negation(q: Column) -> Column:
    return _hits(q, NEGATED, False) > 0


def requires_exact(q: Column) -> Column:
    return _hits(q, EXACT, True) > 0


def strategy(kind: Column, negated: Column, exact: Column) -> Column:
    """Struct of the ``strategy`` for a kind and its ``params`` as JSON; negation
    and exact terms add a parameter to the other kinds."""
    name, params = F.lit("hybrid"), F.lit(json.dumps({"alpha": 0.8, "top_k": 20}))
    for k, (s, p) in STRATEGIES.items():
        name = F.when(kind == k, s).otherwise(name)
        params = F.when(kind == k, json.dumps(p)).otherwise(params)
    more = F.concat(F.when(negated & (kind != "negation"), ', "handle_negation": true').otherwise(""), F.when(exact & (kind != "exact_match"), ', "boost_exact_match": true').otherwise(""))
    return F.struct(name.alias("strategy"), F.concat(F.substring(params, F.lit(1), F.length(params) - 1), more, F.lit("}")).alias("params"))


def routing(kind: Column, negated: Column) -> Column:
    """Struct of the steps before and after retrieval."""
    steps = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    before = steps(F.when(kind == "conversational", "contextualize_query"))
    after = steps(F.when(kind.isin("aggregative", "comparative"), "ensure_diversity"), F.when(negated, "filter_negative_content"))
    return F.struct(before.alias("pre_processing"), after.alias("post_processing"))


def analyse(q: Column, language: Column | None = None) -> Column:
    """All of a query's analysis as one struct."""

    def all_of(x: Column) -> Column:
        kind, negated, exact = x["c"]["kind"], x["negated"], x["exact"]
        s, r = strategy(kind, negated, exact), routing(kind, negated)
        return F.struct(
            kind.alias("kind"), x["c"]["confidence"].alias("confidence"), x["entities"].alias("entities"), x["temporal"].alias("temporal_markers"), negated.alias("has_negation"), exact.alias("requires_exact"),
            s["strategy"].alias("strategy"), s["params"].alias("params"), r["pre_processing"].alias("pre_processing"), r["post_processing"].alias("post_processing"),
        )

    return _let(F.struct(classify(q, language).alias("c"), has_negation(q).alias("negated"), requires_exact(q).alias("exact"), entities(q).alias("entities"), temporal_markers(q).alias("temporal")), all_of)

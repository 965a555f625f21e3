"""What a query asks for: weight of meaning against words, route, negation, grade of a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.functions.columns import WORD, whitespace_tokens

# Patterns and weights that decide the results.
QUESTION = r"\b(what|why|how|which|when|where|who|explain|describe|compare)\b"
EXACT = r'"[^"]+"|\b(id|code|number|version|sku|isbn)\b'
TECHNICAL = r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b|\b\w+_\w+\b|\b\w+-\w+\b"
ENTITY = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
NUMERIC = r"\b\d{4}[-/]\d{2}[-/]\d{2}\b|\b\d+\.?\d*\b"
TYPE_WEIGHT = {
    "factoid": 0.05, "analytical": 0.15, "comparative": 0.12, "procedural": 0.08, "navigational": -0.05, "aggregative": 0.10,
    "exact_match": -0.25, "temporal": -0.05, "negation": 0.10, "multi_hop": 0.15, "conversational": 0.08,
}
MULTI_HOP = [
    r"\band\b.*\b(what|how|why|when|where|who)", r"\bafter\b.*\b(what|how|why|when|where|who)", r"\bbefore\b.*\b(what|how|why|when|where|who)",
    r"\brelate", r"\bconnect", r"\bcompare", r"\bcontrast", "difference between", "relationship between", "impact of.*on",
]
NAMED = [r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+", r"\b(?:CEO|CTO|CFO|President|Director)\b", r"\b(?:Inc\.|Corp\.|LLC|Ltd\.)\b"]
EXPLORATORY = [r"\bexplore\b", r"\binvestigate\b", r"\bfind out\b", r"\btell me about\b", r"\blearn about\b", r"\bunderstand\b", r"\boverview\b", r"\bsummary\b", r"\bexplain\b"]
ASKING = ["what", "which", "how", "why", "when", "where", "who", "whom"]
VERBS = ["is", "are", "was", "were", "do", "does", "did", "can", "will", "should"]
NEGATION = ["not", "no", "none", "never", "nothing", "nobody", "nowhere", "neither", "nor", "without", "lacking", "absent", "excluding"]
EXCLUSION = [r"\bexclude\b", r"\bexcept\b", r"\bbut not\b", r"\bother than\b", r"\baside from\b", r"\bapart from\b", r"\brather than\b", r"\binstead of\b"]
CONTRAST = [r"\balternative to\b", r"\bdifferent from\b", r"\bopposite of\b", r"\bcontrary to\b", r"\bversus\b", r"\bvs\.?\b"]


def _found(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _words(q: Column) -> Column:
    return F.size(whitespace_tokens(q))


# What a query's analysis adds, each times its confidence.
ANALYSIS_WEIGHT = {"has_negation": 0.12, "requires_exact": -0.20, "temporal": -0.08}


def adaptive_alpha(q: Column, kind: Column | None = None, base: float = 0.7, low: float = 0.2, high: float = 0.95, analysis: Column | None = None) -> Column:
    """Weight of vector search for a query: ``base`` moved by the query's length,
    question words, exact terms, technical terms, names, numbers, kind, what its
    ``analysis`` (as of ``classify.analyse``) says and quoted phrases, and held
    within bounds."""
    n = _words(q)
    names = _found(q, ENTITY) - _found(q, r"\b(?:What|Why|How|Which|When|Where|Who)\b(?!\s+[A-Z][a-z])")
    a = F.lit(base) + F.when(n > 12, 0.10).when(n > 8, 0.05).when(n <= 3, -0.10).otherwise(0.0)
    a = a + F.when(F.lower(q).rlike(QUESTION), 0.10).otherwise(0.0) + F.when(q.rlike(f"(?i){EXACT}"), -0.20).otherwise(0.0)
    a = a + F.when(q.rlike(TECHNICAL), -0.10).otherwise(0.0) + F.when(names >= 2, 0.08).otherwise(0.0) + F.when(q.rlike(NUMERIC), -0.08).otherwise(0.0)
    if kind is not None:
        w = F.lit(0.0)
        for k, v in TYPE_WEIGHT.items():
            w = F.when(F.lower(kind) == k, v).otherwise(w)
        a = a + w
    if analysis is not None:
        sure = F.coalesce(analysis["confidence"], F.lit(1.0))
        on = {"has_negation": analysis["has_negation"], "requires_exact": analysis["requires_exact"], "temporal": F.size(analysis["temporal_markers"]) > 0}
        for k, v in ANALYSIS_WEIGHT.items():
            a = a + F.when(on[k], v * sure).otherwise(0.0)
    a = a + F.when(q.rlike('"[^"]+"'), -0.15).otherwise(0.0)
    return F.greatest(F.lit(low), F.least(F.lit(high), a))


# What the service looks for, and the weight it then takes.
SERVICE_ALPHA = [
    (["id:", "code:", "exact:", "specific:", "#"], 0.9),
    (["explain", "describe", "what is", "how does", "why"], 0.6),
    (["compare", "difference", "versus", "vs"], 0.7),
]


def service_alpha(q: Column, default: float = 0.7) -> Column:
    """The simpler weight: the first group of which any word is in the query."""
    low, out = F.lower(q), None
    for words, a in SERVICE_ALPHA:
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
        out = F.when(hit, a) if out is None else out.when(hit, a)
    return out.otherwise(default)


def alpha_band(a: Column) -> Column:
    return F.when(a >= 0.8, "semantic").when(a >= 0.6, "mostly semantic").when(a >= 0.4, "balanced").when(a >= 0.25, "mostly keyword").otherwise("keyword")


def route(q: Column) -> Column:
    """One of six kinds of query, the first that holds."""
    low, n = F.lower(q), _words(q)
    any_of = lambda c, ps: F.coalesce(c.rlike("|".join(f"(?:{p})" for p in ps)), F.lit(False))
    asks = any_of(low, ASKING)
    names = sum((_found(q, p) for p in NAMED[1:]), _found(q, NAMED[0]))
    verbs = F.arrays_overlap(whitespace_tokens(q), F.array(*map(F.lit, VERBS)))
    own = F.arrays_overlap(whitespace_tokens(q), F.array(F.lit("how"), F.lit("why")))
    vague = ((n <= 3) & ~asks) | ((n >= 2) & (n <= 5) & ~verbs & ~asks)
    return (
        F.when(any_of(low, MULTI_HOP), "multi_hop")
        .when(names >= 2, "entity_centric")
        .when(any_of(low, EXPLORATORY), "exploratory")
        .when(vague, "vague_or_sparse")
        .when(((n > 10) & asks) | own, "factual_complex")
        .otherwise("factual_simple")
    )


#: What each kind of query turns on.
STRATEGY = {
    "multi_hop": {"hybrid": True, "graph": 2, "rerank": True, "variations": 0, "hypothetical": 0},
    "entity_centric": {"hybrid": True, "graph": 1, "rerank": True, "variations": 0, "hypothetical": 0},
    "exploratory": {"hybrid": True, "graph": 0, "rerank": True, "variations": 3, "hypothetical": 0},
    "vague_or_sparse": {"hybrid": True, "graph": 0, "rerank": True, "variations": 0, "hypothetical": 3},
    "factual_complex": {"hybrid": True, "graph": 0, "rerank": True, "variations": 0, "hypothetical": 0},
    "factual_simple": {"hybrid": True, "graph": 0, "rerank": False, "variations": 0, "hypothetical": 0},
}


def negation(q: Column) -> Column:
    """Struct of the kind of negation, the terms it covers, a confidence and the
    query in two: what is wanted and what is not.

    Negative words cover up to three words after them. An exclusion, the first of
    the list that is found, wins over them; a contrast counts only without
    either. The wanted part has lost negative words and phrases, but not the
    terms they cover, and is the query itself if nothing is left.
    """
    words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    low = F.lower(q)
    negative = F.array(*map(F.lit, NEGATION))
    none = F.array().cast("array<string>")
    explicit = F.arrays_overlap(whitespace_tokens(q), negative)
    covered = F.flatten(F.transform(words, lambda w, i: F.when(F.array_contains(negative, F.lower(w)), F.slice(words, i + 2, F.lit(3))).otherwise(none)))
    first = lambda ps: F.coalesce(*[F.when(low.rlike(p), F.regexp_extract(low, rf"{p}\s+(\w+(?:\s+\w+)*)", 1)) for p in ps])
    excluded, contrast = first(EXCLUSION), first(CONTRAST)
    one = lambda c: F.when(c != "", F.array(c)).otherwise(none)
    terms = F.concat(F.when(explicit, covered).otherwise(none), F.when(excluded.isNotNull(), one(excluded)).when(~explicit & contrast.isNotNull(), one(contrast)).otherwise(none))
    kind = F.when(excluded.isNotNull(), "exclusion").when(explicit, "explicit").when(contrast.isNotNull(), "contrast").otherwise("none")
    sure = F.when(explicit, 0.9).when(excluded.isNotNull(), 0.85).when(contrast.isNotNull(), 0.75).otherwise(0.0)
    left = F.array_join(F.filter(words, lambda w: ~F.array_contains(negative, F.lower(w))), " ")
    for p in EXCLUSION + CONTRAST:
        left = F.regexp_replace(left, f"(?i){p}", "")
    left = F.trim(F.regexp_replace(left, r"\s+", " "))
    some = (kind != "none") & (F.size(terms) > 0)
    wanted = F.when(some & (left != ""), left).otherwise(q)
    return F.struct(kind.alias("kind"), terms.alias("terms"), sure.alias("confidence"), wanted.alias("positive_query"), F.when(some, F.array_join(terms, " ")).alias("negative_query"))


def variations(q: Column) -> Column:
    """The query and two rewordings of it."""
    return F.array(q, F.concat(F.lit("What is "), q, F.lit("?")), F.concat(F.lit("How does "), q, F.lit(" work?")))


# Factors by kind of query, and the fallbacks in the order they are suggested.
KIND_FACTOR = {"aggregative": 0.9, "multi_hop": 0.85}
EXACT_FACTOR, EXACT_LEAST = 0.7, 0.8


def grade(df: DataFrame, expected: int = 3, high: float = 0.8, medium: float = 0.5, minimum: float = 0.2, queries: DataFrame | None = None) -> DataFrame:
    """``(query_id, confidence, level, issues, fallbacks)`` of each ranked list,
    from its best score, spread, lead, length and decay.

    ``queries(query_id, kind, requires_exact)`` adds queries without a row, which
    are very low, and factors by kind. Issues are names; fallbacks the first
    three that apply, none for a high list.
    """
    g = df.groupBy("query_id").agg(
        F.max("score").alias("best"),
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("sd"),
        F.count("*").alias("n"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
        F.max(F.when(F.col("rank") == 3, F.col("score"))).alias("third"),
    )
    if queries is not None:
        g = queries.select("query_id", "kind", "requires_exact").join(g, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    else:
        g = g.withColumns({"kind": F.lit(None).cast("string"), "requires_exact": F.lit(False)})
    best = F.col("best")
    lead, decay = best - F.col("second"), (best - F.col("third")) / F.greatest(best, F.lit(0.01))
    size = F.when(best < 0.5, 0.3).when(best < 0.7, 0.6).otherwise(1.0)
    spread = F.when(F.col("n") < 2, 0.5).when(F.col("sd") < 0.05, 0.4).when(F.col("sd") < 0.15, 0.7).otherwise(1.0)
    gap = F.when(lead.isNull(), 0.5).when(lead > 0.2, 1.0).when(lead > 0.1, 0.7).when(lead < 0.03, 0.3).otherwise(0.5)
    count = F.when(F.col("n") < expected, 0.4).when(F.col("n") < 2 * expected, 0.7).otherwise(1.0)
    fall = F.when(decay.isNull(), 0.5).when(decay > 0.7, 0.4).when(decay < 0.3, 1.0).otherwise(0.7)
    weak_exact = (F.col("kind") == "exact_match") & (best < EXACT_LEAST)
    factor = F.when(F.col("kind") == "aggregative", KIND_FACTOR["aggregative"]).when(F.col("kind") == "multi_hop", KIND_FACTOR["multi_hop"]).when(weak_exact, EXACT_FACTOR).otherwise(1.0)
    empty = F.col("n") == 0
    c = F.when(empty, 0.0).otherwise((0.30 * size + 0.20 * spread + 0.20 * gap + 0.15 * count + 0.15 * fall) * factor)
    some = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    issues = F.when(empty, F.array(F.lit("no_results"))).otherwise(some(
        F.when(best < 0.5, "low_top_score"), F.when((F.col("n") > 1) & (F.col("sd") < 0.05), "low_variance"), F.when(lead < 0.03, "minimal_gap"),
        F.when(F.col("n") < expected, "few_results"), F.when(decay > 0.7, "sharp_decay"), F.when(weak_exact, "weak_exact_match"),
    ))
    few, low, sharp, poor = F.col("n") < 3, F.col("mean") < 0.4, decay > 0.7, best < 0.5
    exact, kind = F.coalesce("requires_exact", F.lit(False)), F.col("kind")
    wanted = some(
        F.when(few, "expand_search"), F.when(few, "relax_filters"), F.when(low, "multi_query"), F.when(low, "switch_strategy"), F.when(sharp, "broader_context"), F.when(sharp, "graph_expansion"),
        F.when(poor & exact, "full_text_search"), F.when(poor & ~exact, "switch_strategy"), F.when(poor & ~exact, "multi_query"),
        F.when(kind == "multi_hop", "graph_expansion"), F.when(kind == "exact_match", "full_text_search"), F.when(kind == "aggregative", "expand_search"),
    )
    g = g.select("query_id", F.round(c, 6).alias("confidence"), issues.alias("issues"), F.when(empty, F.array(*map(F.lit, ("expand_search", "relax_filters", "multi_query")))).otherwise(F.slice(F.array_distinct(wanted), 1, 3)).alias("fallbacks"))
    level = F.when(F.col("confidence") >= high, "high").when(F.col("confidence") >= medium, "medium").when(F.col("confidence") >= minimum, "low").otherwise("very_low")
    g = g.withColumn("level", level)
    return g.select("query_id", "confidence", "level", "issues", F.when(F.col("level") == "high", F.array().cast("array<string>")).otherwise(F.col("fallbacks")).alias("fallbacks"))


def lexical_grounding(answer: Column, sources: Column) -> Column:
    """Share of an answer's distinct words that its sources hold; 0 without words."""
    a = F.array_distinct(F.regexp_extract_all(F.lower(answer), F.lit(f"({WORD})"), 1))
    s = F.array_distinct(F.regexp_extract_all(F.lower(sources), F.lit(f"({WORD})"), 1))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, s)) / F.size(a)).otherwise(F.lit(0.0))


def extractive_summary(text: Column, title: Column | None = None, most: int = 3, length: int = 500, tokens: int = 150) -> Column:
    """The title as a sentence and the first sentences of a text, until they pass
    ``tokens``, cut to ``length`` characters. Text is cut at full stops followed
    by a space; every sentence gets its stop back."""
    parts = F.filter(F.transform(F.split(text, r"\. "), lambda s: F.trim(s)), lambda s: s != "")
    sentences = F.slice(F.transform(parts, lambda s: F.when(F.endswith(s, F.lit(".")), s).otherwise(F.concat(s, F.lit(".")))), 1, most)
    start = F.lit("") if title is None else F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit("."))).otherwise("")
    joined = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit(" "), b))
    # A sentence is added while what stands before it is within the limit.
    full = F.aggregate(sentences, F.struct(start.alias("s"), F.lit(False).alias("over")), lambda a, x: F.when(a["over"], a).otherwise(F.struct(joined(a["s"], x).alias("s"), (F.length(joined(a["s"], x)) > 4 * tokens).alias("over"))))
    return F.substring(full["s"], 1, length)


def last_turns(df: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The last rows of each group, latest first."""
    return df.withColumn("back", F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("back") <= most)

"""Queries about queries: kinds, strategies, negation, hops, filters, verdicts.

The question texts are made of the words of all ``eval_items``: twelve forms of
questions, one for each item by its number.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators import classify, context, filters, multihop, ranked, retrieval, search, telemetry, understanding, verify
from corvine.plans.catalog import BM, SQL, V, bm25_run, other_run, query, rounded, vector_run, vectors
from corvine.sources import sinks
from corvine.storage import read_table

FORMS = [
    "'Compare ' || w1 || ' and ' || w2",
    "'What is the ' || w1 || ' of the ' || w2 || ' that ' || w3 || '?'",
    "'How to implement ' || w1 || ' without ' || w2 || ' or ' || w3",
    "'list all ' || w1 || ' about ' || w2",
    "'show page ' || n || ' of the ' || w1 || ' section from 2023 Q2 report'",
    "'REQ-' || n || ' \"' || w1 || ' ' || w2 || '\"'",
    "'latest ' || w1 || ' in quarter 3 other than ' || w2 || ' ' || w3",
    "'based on ' || w1 || ' and then ' || w2",
    "'it ' || w1 || ' is not ' || w2 || ' ' || w3",
    "'why does ' || w1 || ' differ from ' || w2 || '? explain the reason'",
    "'in the Security section from document \"' || w1 || '.pdf\" table'",
    "w1 || ' versus ' || w2 || ', policy and guide'",
]
_CASE = "CASE " + " ".join(f"WHEN item_id % {len(FORMS)} = {i} THEN {f}" for i, f in enumerate(FORMS)) + " END"
Q = rf"""q0 AS (SELECT item_id, lang, text, regexp_extract_all(text, '\p{{L}}+') AS w, CAST(item_id AS VARCHAR) AS n FROM eval_items),
    q1 AS (SELECT *, coalesce(w[1], '') AS w1, coalesce(w[2], '') AS w2, coalesce(w[3], '') AS w3 FROM q0),
    q AS (SELECT item_id, lang, text, {_CASE} AS query, lower({_CASE}) AS low FROM q1)"""


def asked(s: SparkSession, d: str) -> DataFrame:
    """``(item_id, lang, text, query)``."""
    w = F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)
    word = lambda i: F.coalesce(F.get(w, i), F.lit(""))
    x = read_table(s, d, "eval_items").select("item_id", "lang", "text", word(0).alias("w1"), word(1).alias("w2"), word(2).alias("w3"), F.col("item_id").cast("string").alias("n"))
    return x.select("item_id", "lang", "text", F.expr(_CASE).alias("query"))


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _count(patterns: list[str], of: str, flags: str = "(?i)") -> str:
    return "(" + " + ".join(f"CASE WHEN regexp_matches({of}, {_s(flags + p)}) THEN 1 ELSE 0 END" for p in patterns) + ")"


def _scores(languages: bool) -> str:
    out = []
    for kind, ps in classify.PATTERNS.items():
        hits, n = _count(ps, "query", "" if kind in classify.CASED else "(?i)"), str(len(ps))
        if languages and kind in classify.MULTILINGUAL["en"]:
            hits += " + CASE " + " ".join(f"WHEN lang = '{x}' THEN {_count(m[kind], 'query')}" for x, m in classify.MULTILINGUAL.items()) + f" ELSE {_count(classify.MULTILINGUAL['en'][kind], 'query')} END"
            n += " + CASE " + " ".join(f"WHEN lang = '{x}' THEN {len(m[kind])}" for x, m in classify.MULTILINGUAL.items()) + f" ELSE {len(classify.MULTILINGUAL['en'][kind])} END"
        out.append(f"SELECT item_id, '{kind}' AS kind, {len(out)} AS place, least(1.0, CAST({hits} AS DOUBLE) / ({n}) + 0.5) AS score FROM q WHERE {hits} > 0")
    return f"""k0 AS ({' UNION ALL '.join(out)}), k1 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, place) AS r FROM k0),
    k AS (SELECT q.*, coalesce(k1.kind, 'factoid') AS kind, coalesce(k1.score, 0.5) AS confidence FROM q LEFT JOIN k1 ON k1.item_id = q.item_id AND k1.r = 1)"""


@query("query_classify", f"WITH {Q}, {_scores(False)} SELECT item_id, kind, round(CAST(confidence AS DOUBLE), 4) AS confidence FROM k")
def _(s, d):
    c = classify.classify(F.col("query"))
    return rounded(asked(s, d).select("item_id", c["kind"].alias("kind"), c["confidence"].alias("confidence")), "confidence")


@query("query_classify_multilingual", f"WITH {Q}, {_scores(True)} SELECT item_id, kind, round(CAST(confidence AS DOUBLE), 4) AS confidence FROM k")
def _(s, d):
    c = classify.classify(F.col("query"), F.col("lang"))
    return rounded(asked(s, d).select("item_id", c["kind"].alias("kind"), c["confidence"].alias("confidence")), "confidence")


_STRATEGY = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in classify.STRATEGIES.items()) + " END"
_PARAMS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {_s(json.dumps(v[1])[:-1])}" for k, v in classify.STRATEGIES.items()) + " END"


@query(
    "query_strategy",
    f"""WITH {Q}, {_scores(False)}, f AS (SELECT *, {_count(classify.NEGATED, 'query')} > 0 AS neg, {_count(classify.EXACT, 'query', '')} > 0 AS exact FROM k)
    SELECT item_id, {_STRATEGY} AS strategy, {_PARAMS} || CASE WHEN neg AND kind <> 'negation' THEN ', "handle_negation": true' ELSE '' END || CASE WHEN exact AND kind <> 'exact_match' THEN ', "boost_exact_match": true' ELSE '' END || '}}' AS params,
      CASE WHEN kind = 'conversational' THEN 'contextualize_query' ELSE '' END AS before, concat_ws(' ', CASE WHEN kind IN ('aggregative', 'comparative') THEN 'ensure_diversity' END, CASE WHEN neg THEN 'filter_negative_content' END) AS after FROM f""",
)
def _(s, d):
    a = asked(s, d).select("item_id", classify.analyse(F.col("query")).alias("a"))
    return a.select("item_id", "a.strategy", "a.params", F.array_join("a.pre_processing", " ").alias("before"), F.array_join("a.post_processing", " ").alias("after"))


@query(
    "query_markers",
    f"""WITH {Q} SELECT item_id, array_to_string(list_sort(list_distinct({' || '.join(f"regexp_extract_all(query, {_s(p)})" for p in classify.ENTITIES)})), '; ') AS entities,
      array_to_string({' || '.join(f"regexp_extract_all(query, {_s('(?i)' + p)})" for p in classify.TEMPORAL)}, '; ') AS temporal, {_count(classify.NEGATED, 'query')} > 0 AS negated, {_count(classify.EXACT, 'query', '')} > 0 AS exact FROM q""",
)
def _(s, d):
    a = asked(s, d).select("item_id", classify.analyse(F.col("query")).alias("a"))
    return a.select("item_id", F.array_join(F.array_sort("a.entities"), "; ").alias("entities"), F.array_join("a.temporal_markers", "; ").alias("temporal"), F.col("a.has_negation").alias("negated"), F.col("a.requires_exact").alias("exact"))


def _first(ps: list[str], after: bool) -> str:
    tail = r"\s+(\w+(?:\s+\w+)*)"
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(low, {_s(p)}) THEN " + (f"regexp_extract(low, {_s(p + tail)}, 1)" if after else "1") + " END" for p in ps) + ")"


_NEG = "[" + ", ".join(f"'{w}'" for w in understanding.NEGATION) + "]"
_LEFT = "array_to_string(list_filter(words, lambda x: NOT list_contains(" + _NEG + ", lower(x))), ' ')"
for _p in understanding.EXCLUSION + understanding.CONTRAST:
    _LEFT = f"regexp_replace({_LEFT}, {_s('(?i)' + _p)}, '', 'g')"


@query(
    "negation_detect",
    rf"""WITH {Q}, a AS (SELECT *, list_filter(regexp_split_to_array(query, '\s+'), lambda x: x <> '') AS words FROM q),
    b AS (SELECT *, flatten([words[i + 1 : i + 3] FOR i IN range(1, len(words) + 1) IF list_contains({_NEG}, lower(words[i]))]) AS covered, list_has_any(list_transform(words, lambda x: lower(x)), {_NEG}) AS explicit,
      {_first(understanding.EXCLUSION, True)} AS ex, {_first(understanding.CONTRAST, True)} AS co FROM a),
    c AS (SELECT *, CASE WHEN ex IS NOT NULL THEN 'exclusion' WHEN explicit THEN 'explicit' WHEN co IS NOT NULL THEN 'contrast' ELSE 'none' END AS kind,
      concat_ws(' ', CASE WHEN explicit AND len(covered) > 0 THEN array_to_string(covered, ' ') END, CASE WHEN ex IS NOT NULL THEN nullif(ex, '') WHEN NOT explicit AND co IS NOT NULL THEN nullif(co, '') END) AS terms,
      trim(regexp_replace({_LEFT}, '\s+', ' ', 'g')) AS rest FROM b)
    SELECT item_id, kind, terms, CAST(CASE WHEN explicit THEN 0.9 WHEN ex IS NOT NULL THEN 0.85 WHEN co IS NOT NULL THEN 0.75 ELSE 0 END AS DOUBLE) AS confidence,
      CASE WHEN kind <> 'none' AND terms <> '' AND rest <> '' THEN rest ELSE query END AS positive_query, CASE WHEN kind <> 'none' AND terms <> '' THEN terms END AS negative_query FROM c""",
)
def _(s, d):
    n = asked(s, d).select("item_id", understanding.negation(F.col("query")).alias("n"))
    return n.select("item_id", "n.kind", F.array_join("n.terms", " ").alias("terms"), "n.confidence", "n.positive_query", "n.negative_query")


_X = lambda p: f"nullif(regexp_extract(query, {_s('(?i)' + p)}, 1), '')"
SQL_IMPLIED = rf"""SELECT item_id, CAST(nullif(regexp_extract(query, '\b(20\d\d|19\d\d)\b', 1), '') AS INT) AS date_year,
      CASE WHEN regexp_matches(low, '\b(q1|quarter\s+1)\b') THEN 1 WHEN regexp_matches(low, '\b(q2|quarter\s+2)\b') THEN 2 WHEN regexp_matches(low, '\b(q3|quarter\s+3)\b') THEN 3 WHEN regexp_matches(low, '\b(q4|quarter\s+4)\b') THEN 4 END AS quarter,
      CASE WHEN regexp_matches(low, '\b(report|annual report|quarterly report)\b') THEN 'report' WHEN regexp_matches(low, '\b(policy|policies|guideline)\b') THEN 'policy' WHEN regexp_matches(low, '\b(contract|agreement|terms)\b') THEN 'contract'
        WHEN regexp_matches(low, '\b(invoice|bill|receipt)\b') THEN 'invoice' WHEN regexp_matches(low, '\b(manual|guide|documentation)\b') THEN 'manual' WHEN regexp_matches(low, '\b(spec|specification|requirements?)\b') THEN 'specification' END AS doc_type,
      nullif(regexp_extract(query, '(?i)\b(?:in|from)\s+(?:the\s+)?(\w+)\s+section\b', 1), '') AS section, nullif(regexp_extract(query, '(?i)\b(?:from|in)\s+(?:document|file)\s+["'']?([^"'']+)["'']?\b', 1), '') AS filename,
      regexp_matches(low, '\btable\b') AS is_table FROM q"""


@query("implied_filters", f"WITH {Q} {SQL_IMPLIED}")
def _(s, d):
    return asked(s, d).select("item_id", filters.implied(F.col("query")).alias("f")).select("item_id", "f.*")


@query(
    "implied_filter_join",
    f"WITH {Q}, f AS ({SQL_IMPLIED}), r AS (SELECT doc_id, lower(doc_type) AS doc_type, lower(filename) AS filename, CAST(year(ingested_at) AS INT) AS date_year, CAST(quarter(ingested_at) AS INT) AS quarter FROM documents), "
    "m AS (SELECT f.item_id, r.doc_id FROM f JOIN r ON (f.date_year IS NULL OR f.date_year = r.date_year) AND (f.quarter IS NULL OR f.quarter = r.quarter) AND (f.doc_type IS NULL OR contains(r.doc_type, f.doc_type)) AND (f.filename IS NULL OR contains(r.filename, lower(f.filename)))) "
    "SELECT item_id, count(*) AS n FROM m GROUP BY 1",
)
def _(s, d):
    r = read_table(s, d, "documents").select("doc_id", "doc_type", "filename", F.year("ingested_at").alias("date_year"), F.quarter("ingested_at").alias("quarter"))
    q = asked(s, d).select(F.col("item_id").alias("query_id"), F.col("query").alias("text"))
    return filters.matching(q, r).groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").alias("n"))


_MATCH = lambda ps: "(" + " OR ".join(f"regexp_matches(low, {_s(p)})" for p in ps) + ")"
SQL_HOPS = rf"""h0 AS (SELECT item_id, query, {_MATCH(multihop.SEQUENTIAL)} AS seq, {_MATCH(multihop.COMPARISON)} AS cmp, {_MATCH(multihop.AGGREGATION)} AS agg, regexp_extract(query, '(?i){multihop.SIDES}', 1) AS a, regexp_extract(query, '(?i){multihop.SIDES}', 2) AS b,
      regexp_extract(query, '^\s*(\S+)', 1) AS aspect, CASE WHEN regexp_matches(low, '\s+and then\s+') THEN '(?i)\s+and then\s+' WHEN regexp_matches(low, '\s+then\s+') THEN '(?i)\s+then\s+' WHEN regexp_matches(low, '\s+and\s+') THEN '(?i)\s+and\s+' END AS cut FROM q),
    h1 AS (SELECT *, CASE WHEN seq THEN 'sequential' WHEN cmp THEN 'parallel' WHEN agg THEN 'hierarchical' ELSE 'single' END AS reasoning,
      CASE WHEN seq THEN CASE WHEN cut IS NULL THEN [trim(query)] ELSE [trim(regexp_split_to_array(query, cut)[1]), trim(substring(regexp_replace(query, cut, chr(1)), instr(regexp_replace(query, cut, chr(1)), chr(1)) + 1))] END
        WHEN cmp THEN CASE WHEN a <> '' THEN [aspect || ' ' || a, aspect || ' ' || b, query] ELSE [query] END WHEN agg THEN [query, query] ELSE [query] END AS hops FROM h0)"""


@query("multihop_plan", f"WITH {Q}, {SQL_HOPS} SELECT item_id, reasoning, array_to_string(hops, ' / ') AS hops, CAST(CASE WHEN len(hops) > 1 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence FROM h1")
def _(s, d):
    p = asked(s, d).select("item_id", multihop.decompose(F.col("query")).alias("p"))
    return p.select("item_id", "p.reasoning", F.array_join(F.transform("p.hops", lambda h: h["query"]), " / ").alias("hops"), "p.confidence")


_HOP_BM = BM.replace(
    "q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM eval_items) GROUP BY ALL)",
    "hq AS (SELECT item_id, (k - 1) AS hop, hops[k] AS text FROM (SELECT item_id, hops, unnest(range(1, len(hops) + 1)) AS k FROM h1)), q9 AS (SELECT item_id * 10 + hop AS item_id, term, count(*) AS times FROM (SELECT item_id, hop, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM hq) GROUP BY ALL)",
).replace("FROM q JOIN i USING", "FROM q9 JOIN i USING")


@query(
    "multihop_execute",
    f"""WITH {Q}, {SQL_HOPS}, {_HOP_BM}, u AS (SELECT query_id // 10 AS query_id, chunk_id, max(score) AS score FROM r WHERE rank <= 5 GROUP BY ALL),
    v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM u) SELECT query_id, chunk_id, round(score, 3) AS score FROM v WHERE rank <= 5""",
)
def _(s, d):
    docs = read_table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    hops = multihop.plan(asked(s, d).select(F.col("item_id").alias("query_id"), F.col("query").alias("text")))
    return rounded(multihop.execute(hops, lambda q, k: search.bm25(docs, q, k), 5), "score", places=3).drop("rank")


@query(
    "answer_verify",
    rf"""WITH {BM}, {Q.replace('q AS (', 'qq AS (', 1)}, x AS (SELECT r.query_id, qq.query, qq.text AS answer, lower(qq.text) AS low, coalesce(d.text, '') AS src FROM r JOIN qq ON qq.item_id = r.query_id JOIN documents d ON d.doc_id = r.chunk_id WHERE r.rank <= 1),
    y AS (SELECT *, list_filter(list_distinct(regexp_split_to_array(low, '\s+')), lambda w: w <> '' AND NOT list_contains([{', '.join(_s(w) for w in verify.STOP_WORDS)}], w)) AS own, list_distinct(regexp_split_to_array(lower(src), '\s+')) AS theirs,
      len(list_filter(regexp_split_to_array(answer, '\s+'), lambda w: w <> '')) AS n, regexp_extract_all(answer, '\b\d+(?:\.\d+)?%?') AS nums FROM x),
    z AS (SELECT *, 0.4 * CASE WHEN len(own) > 0 THEN len(list_intersect(own, theirs)) / len(own) ELSE 0 END AS grounding, CASE WHEN {_MATCH(verify.CONTRADICTION)} THEN 0.5 ELSE 0.9 END AS consistency,
      CASE WHEN n < 5 THEN 0.4 WHEN {_MATCH(verify.INCOMPLETE)} THEN 0.3 ELSE 0.8 END AS completeness, len(nums) > 0 AND len(list_filter(nums, lambda m: NOT contains(src, m))) > 0.5 * len(nums) AS invented FROM y),
    c AS (SELECT *, greatest(0, 0.45 * grounding + 0.35 * consistency + 0.2 * completeness - least(0.3, 0.15 * (CASE WHEN grounding < 0.4 THEN 1 ELSE 0 END + CASE WHEN invented THEN 1 ELSE 0 END))) AS confidence FROM z)
    SELECT query_id, round(CAST(grounding AS DOUBLE), 4) AS grounding, round(CAST(confidence AS DOUBLE), 4) AS confidence, CASE WHEN invented THEN 'hallucination' WHEN confidence >= 0.8 AND grounding >= 0.7 THEN 'verified' WHEN confidence >= 0.6 THEN 'likely_correct' ELSE 'uncertain' END AS status,
      CASE WHEN invented THEN false WHEN confidence >= 0.7 THEN true WHEN grounding < 0.4 THEN false ELSE confidence >= 0.4 END AS present FROM c""",
)
def _(s, d):
    items = read_table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("answer"))
    top = bm25_run(s, d, 1).join(read_table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id").join(items, "query_id")
    v = verify.verify(F.lit("factoid"), F.col("answer"), F.col("text"))
    return rounded(top.select("query_id", v.alias("v")).select("query_id", "v.grounding", "v.confidence", "v.status", "v.present"), "grounding", "confidence")


@query("service_alpha", f"WITH {Q} SELECT item_id, CAST(CASE WHEN contains(low, 'id:') OR contains(low, 'code:') OR contains(low, 'exact:') OR contains(low, 'specific:') OR contains(low, '#') THEN 0.9 WHEN contains(low, 'explain') OR contains(low, 'describe') OR contains(low, 'what is') OR contains(low, 'how does') OR contains(low, 'why') THEN 0.6 WHEN contains(low, 'compare') OR contains(low, 'difference') OR contains(low, 'versus') OR contains(low, 'vs') THEN 0.7 ELSE 0.5 END AS DOUBLE) AS alpha FROM q")
def _(s, d):
    return asked(s, d).select("item_id", understanding.service_alpha(F.col("query"), 0.5).alias("alpha"))


@query("hyde_count", rf"WITH {Q}, a AS (SELECT *, list_filter(regexp_split_to_array(low, '\s+'), lambda x: x <> '') AS w FROM q) SELECT item_id, CAST(CASE WHEN len(w) < 5 THEN 0 WHEN len(w) < 15 AND list_has_any(w, ['what', 'why', 'how', 'when', 'where', 'who', 'which']) THEN 1 ELSE 3 END AS INT) AS n FROM a")
def _(s, d):
    return asked(s, d).select("item_id", retrieval.hypothetical_count(F.col("query")).alias("n"))


@query("query_checks", rf"WITH {Q} SELECT item_id, CASE WHEN length(query) > 10000 THEN 'query too long' WHEN item_id % 60 < 1 OR item_id % 60 > 50 THEN 'k out of range' WHEN NOT regexp_matches(lang || '-' || (item_id % 7), '^[A-Za-z0-9_-]+$') THEN 'bad collection id' END AS error FROM q")
def _(s, d):
    q = asked(s, d).select(F.col("item_id"), F.col("query").alias("text"), (F.col("item_id") % 60).cast("int").alias("k"), F.concat_ws("-", "lang", (F.col("item_id") % 7).cast("string")).alias("collection_id"))
    return sinks.check_queries(q).select("item_id", "error")


# Lists put in another order.


RR = r"""tok AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS w FROM documents), qt AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM eval_items),
    sc2 AS (SELECT r.query_id, r.chunk_id, r.rank AS old, len(list_intersect(qt.w, tok.w)) / len(qt.w) AS s FROM r JOIN qt ON qt.item_id = r.query_id JOIN tok ON tok.doc_id = r.chunk_id WHERE r.rank <= 10)"""


@query("rerank_floor", f"WITH {BM}, {RR}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM sc2 WHERE s >= 0.3) SELECT query_id, chunk_id, round(s, 4) AS score, rank FROM o WHERE rank <= 5")
def _(s, d):
    items = read_table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")
    docs = read_table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return rounded(retrieval.rerank(bm25_run(s, d, 10), items, docs, 5), "score")


@query("rerank_dropped", f"WITH {BM}, {RR} SELECT query_id, count(*) FILTER (s < 0.3) AS dropped FROM sc2 GROUP BY 1")
def _(s, d):
    items = read_table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")
    docs = read_table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    run = bm25_run(s, d, 10)
    return retrieval.dropped(run, retrieval.rerank(run, items, docs, 10))


@query("rerank_by_scores", f"WITH {V}, t AS (SELECT *, query_id % 200 = 0 AS told, CASE WHEN chunk_id % 2 = 0 THEN (chunk_id % 10) / 10.0 ELSE 0 END AS new FROM a WHERE rank <= 10), o AS (SELECT query_id, chunk_id, CASE WHEN told THEN new ELSE score END AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN told THEN new ELSE 0 END DESC, rank) AS rank FROM t) SELECT query_id, chunk_id, round(CAST(score AS DOUBLE), 4) AS score, rank FROM o WHERE rank <= 5")
def _(s, d):
    run = vector_run(s, d, 10)
    told = run.filter("query_id % 200 = 0 and chunk_id % 2 = 0").select("query_id", "chunk_id", ((F.col("chunk_id") % 10) / 10.0).alias("score"))
    told = told.unionByName(run.filter("query_id % 200 = 0").groupBy("query_id").agg(F.lit(-1).cast("bigint").alias("chunk_id"), F.lit(0.0).alias("score")))  # a query told of may have odd chunks only
    return rounded(retrieval.rerank_by(run, told, 5), "score")


H = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), p AS (SELECT q.vec_id AS doc_no, q.label AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(q.e, c.e) AS s FROM v q, v c WHERE q.vec_id % 100 = 0),
    l AS (SELECT *, row_number() OVER (PARTITION BY doc_no ORDER BY s DESC, chunk_id) AS rank FROM p)"""
H_END = "o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM g) SELECT query_id, chunk_id, round(score, 5) AS score, rank FROM o WHERE rank <= 10"


def _hypothetical(s, d) -> DataFrame:
    return vectors(s, d).filter(F.pmod("chunk_id", F.lit(100)) == 0).select(F.col("label").alias("query_id"), F.col("chunk_id").alias("doc_no"), "embedding")


@query("hyde_max", f"WITH {H}, g AS (SELECT query_id, chunk_id, max(s) AS score FROM l WHERE rank <= 20 GROUP BY ALL), {H_END}")
def _(s, d):
    return rounded(retrieval.hypothetical(_hypothetical(s, d), vectors(s, d), 10, "max"), "score", places=5)


@query("hyde_rrf", f"WITH {H}, g AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS score FROM l WHERE rank <= 20 GROUP BY ALL), {H_END}")
def _(s, d):
    return rounded(retrieval.hypothetical(_hypothetical(s, d), vectors(s, d), 10, "rrf"), "score", places=5)


@query(
    "hyde_direct",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), qv AS (SELECT * FROM v WHERE vec_id % 100 = 0), x AS (SELECT label, unnest(range(1, 65)) AS i, e FROM qv), m AS (SELECT label, i, avg(e[i]) AS x FROM x GROUP BY ALL),
    h AS (SELECT label AS query_id, list(x ORDER BY i) AS e FROM m GROUP BY label), f AS (SELECT label AS query_id, arg_min(e, vec_id) AS e FROM qv GROUP BY 1),
    l1 AS (SELECT h.query_id, v.vec_id AS chunk_id, list_cosine_similarity(h.e, v.e) AS s FROM h, v), l2 AS (SELECT f.query_id, v.vec_id AS chunk_id, list_cosine_similarity(f.e, v.e) AS s FROM f, v),
    t1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r FROM l1), t2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r FROM l2),
    g AS (SELECT query_id, chunk_id, 0.7 * coalesce(a.s, 0) + 0.3 * coalesce(b.s, 0) AS score FROM (SELECT * FROM t1 WHERE r <= 20) a FULL JOIN (SELECT * FROM t2 WHERE r <= 20) b USING (query_id, chunk_id)), """ + H_END,
)
def _(s, d):
    docs = _hypothetical(s, d)
    own = docs.groupBy("query_id").agg(F.min_by("embedding", "doc_no").alias("embedding"))
    return rounded(retrieval.hypothetical_and_direct(docs, own, vectors(s, d), 10), "score", places=5)


@query(
    "hybrid_vector_bm25",
    r"""WITH c AS (SELECT DISTINCT chunk_id, content AS text FROM chunks WHERE content IS NOT NULL),
    v AS (SELECT chunk_id, min(CAST(embedding AS DOUBLE[])) AS e FROM chunk_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
    qs AS (SELECT c.chunk_id AS query_id, c.text, v.e FROM c JOIN v USING (chunk_id) WHERE CAST(regexp_extract(c.chunk_id, '-(\d{9})', 1) AS BIGINT) % 100 = 0),
    vs AS (SELECT query_id, v.chunk_id, list_cosine_similarity(qs.e, v.e) AS s FROM qs, v), vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM vs),
    t AS (SELECT chunk_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM c), tc AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL),
    n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t), df AS (SELECT term, count(*) AS df FROM tc GROUP BY 1), i0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS i FROM df, n), i AS (SELECT term, CASE WHEN i < 0 THEN 0.25 * (SELECT avg(i) FROM i0) ELSE i END AS idf FROM i0),
    qw AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS term FROM qs) GROUP BY ALL),
    ws AS (SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS s FROM qw JOIN i USING (term) JOIN tc USING (term), n GROUP BY ALL), wr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM ws),
    u AS (SELECT query_id, chunk_id, rank FROM vr WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, rank FROM wr WHERE rank <= 20), g AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS score FROM u GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM g) SELECT query_id, chunk_id, round(score, 5) AS score FROM o WHERE rank <= 10""",
)
def _(s, d):
    """Chunks by their own vectors and words: the queries are the chunks of every hundredth document."""
    c = read_table(s, d, "chunks").filter("content is not null").select("chunk_id", F.col("content").alias("text")).distinct()
    sound = (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = read_table(s, d, "chunk_vectors").filter(sound).groupBy("chunk_id").agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))
    q = c.join(v, "chunk_id").filter(F.regexp_extract("chunk_id", r"-(\d{9})", 1).try_cast("bigint") % 100 == 0).select(F.col("chunk_id").alias("query_id"), "embedding", "text")
    return rounded(retrieval.hybrid(v, c, q, 10), "score", places=5).drop("rank")


# Operators whose defaults would leave these lists as they are, with limits that act on them.


@query(
    "contrastive_penalty",
    f"""WITH {V}, n AS (SELECT q.vec_id - 1 AS query_id, c.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, c.e) DESC, c.vec_id) AS rank FROM v q, v c WHERE q.vec_id % 100 = 1 AND q.vec_id <> c.vec_id),
    near AS (SELECT a.query_id, a.chunk_id, a.score, max(list_cosine_similarity(x.e, y.e)) AS near FROM a JOIN v x ON x.vec_id = a.chunk_id LEFT JOIN n ON n.query_id = a.query_id AND n.rank <= 10 LEFT JOIN v y ON y.vec_id = n.chunk_id WHERE a.rank <= 30 GROUP BY ALL),
    z AS (SELECT query_id, chunk_id, score - CASE WHEN near > 0.25 THEN 0.5 * near ELSE 0 END AS score FROM near),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM z WHERE score > 0)
    SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM t WHERE rank <= 10""",
)
def _(s, d):
    v = vectors(s, d).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    neg = vector_run(s, d, 10, 1).withColumn("query_id", F.col("query_id") - 1)
    return rounded(ranked.contrastive(vector_run(s, d, 30), neg, v, 10, limit=0.25), "score")


@query("corrective_merge")
def _(s, d):
    a = vector_run(s, d, 10)
    return rounded(ranked.corrective_merge(a, other_run(s, d, 10), understanding.grade(a, medium=0.62), 10), "score")


SQL["corrective_merge"] = SQL["confidence_grade"].replace(">= 0.5 THEN 'medium'", ">= 0.62 THEN 'medium'").replace("SELECT query_id, confidence, CASE", "g2 AS (SELECT query_id, CASE", 1).rsplit("FROM c", 1)[0].replace("FROM g)\n", "FROM g),\n") + """FROM c),
    u AS (SELECT query_id, chunk_id, score FROM a WHERE rank <= 10 UNION ALL SELECT query_id, chunk_id, score FROM b WHERE rank <= 10),
    m AS (SELECT query_id, chunk_id, max(score) AS score FROM u JOIN g2 USING (query_id) WHERE level IN ('low', 'very_low') GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m),
    o AS (SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 10 UNION ALL SELECT query_id, chunk_id, score, rank FROM a JOIN g2 USING (query_id) WHERE rank <= 10 AND level NOT IN ('low', 'very_low'))
    SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM o"""


@query("greedy_dedup")
def _(s, d):
    return rounded(context.remove_near_duplicates(vector_run(s, d, 20).join(vectors(s, d).select("chunk_id", "embedding"), "chunk_id"), 0.3), "score")


@query(
    "semantic_cache_lookup",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), c AS (SELECT vec_id AS cache_id, e, label % 2 AS k, CASE WHEN label % 3 > 0 THEN 'f' || (label % 3) END AS f, TIMESTAMP '2030-01-01' + INTERVAL (vec_id) SECOND AS ts FROM v WHERE vec_id % 100 <> 0),
    n AS (SELECT * FROM c ORDER BY ts DESC LIMIT 100), l AS (SELECT * FROM n WHERE ts >= (SELECT max(ts) FROM c) - INTERVAL 90 SECOND),
    p AS (SELECT v.vec_id AS query_id, l.cache_id, list_cosine_similarity(v.e, l.e) AS s FROM v JOIN l ON l.k = v.label % 2 AND l.f IS NOT DISTINCT FROM CASE WHEN v.label % 3 > 0 THEN 'f' || (v.label % 3) END WHERE v.vec_id % 100 = 0),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cache_id) AS n FROM p) SELECT query_id, cache_id, round(s, 4) AS cosine FROM b WHERE n = 1 AND s >= 0.2""",
)
def _(s, d):
    v = vectors(s, d).select("chunk_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.col("label") % 2, F.when(F.col("label") % 3 > 0, F.concat(F.lit("f"), (F.col("label") % 3).cast("string")))).toDF("id", "embedding", "k", "filter")
    c = v.filter("id % 100 <> 0").select(F.col("id").alias("cache_id"), "embedding", "k", "filter", (F.timestamp_seconds(F.unix_timestamp(F.lit("2030-01-01"), "yyyy-MM-dd") + F.col("id"))).alias("ts"))
    now = c.agg(F.max("ts")).first()[0]
    q = v.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    return rounded(telemetry.semantic_cache(q, c, str(now), 0.2, 90), "cosine")


@query(
    "grade_with_kinds",
    f"""WITH {V}, g AS (SELECT query_id, max(score) AS best, avg(score) AS mean, stddev_pop(score) AS sd, count(*) AS n, max(CASE WHEN rank = 2 THEN score END) AS b2, max(CASE WHEN rank = 3 THEN score END) AS b3 FROM a WHERE rank <= 10 AND query_id % 400 <> 0 GROUP BY 1),
    k AS (SELECT vec_id AS query_id, CASE label % 4 WHEN 0 THEN 'aggregative' WHEN 1 THEN 'multi_hop' WHEN 2 THEN 'exact_match' ELSE 'factoid' END AS kind, label % 4 = 2 AS exact FROM v WHERE vec_id % 100 = 0),
    j AS (SELECT k.query_id, kind, exact, best, mean, sd, coalesce(n, 0) AS n, b2, b3, (best - b3) / greatest(best, 0.01) AS decay FROM k LEFT JOIN g USING (query_id)),
    c AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE round((0.30 * CASE WHEN best < 0.5 THEN 0.3 WHEN best < 0.7 THEN 0.6 ELSE 1.0 END + 0.20 * CASE WHEN n < 2 THEN 0.5 WHEN sd < 0.05 THEN 0.4 WHEN sd < 0.15 THEN 0.7 ELSE 1.0 END
      + 0.20 * CASE WHEN b2 IS NULL THEN 0.5 WHEN best - b2 > 0.2 THEN 1.0 WHEN best - b2 > 0.1 THEN 0.7 WHEN best - b2 < 0.03 THEN 0.3 ELSE 0.5 END + 0.15 * CASE WHEN n < 3 THEN 0.4 WHEN n < 6 THEN 0.7 ELSE 1.0 END
      + 0.15 * CASE WHEN b3 IS NULL THEN 0.5 WHEN decay > 0.7 THEN 0.4 WHEN decay < 0.3 THEN 1.0 ELSE 0.7 END) * CASE kind WHEN 'aggregative' THEN 0.9 WHEN 'multi_hop' THEN 0.85 WHEN 'exact_match' THEN CASE WHEN best < 0.8 THEN 0.7 ELSE 1 END ELSE 1 END, 6) END AS confidence FROM j)
    SELECT query_id, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.2 THEN 'low' ELSE 'very_low' END AS level,
      CASE WHEN n = 0 THEN 'no_results' ELSE concat_ws(' ', CASE WHEN best < 0.5 THEN 'low_top_score' END, CASE WHEN n > 1 AND sd < 0.05 THEN 'low_variance' END, CASE WHEN best - b2 < 0.03 THEN 'minimal_gap' END, CASE WHEN n < 3 THEN 'few_results' END, CASE WHEN decay > 0.7 THEN 'sharp_decay' END, CASE WHEN kind = 'exact_match' AND best < 0.8 THEN 'weak_exact_match' END) END AS issues,
      CASE WHEN n = 0 THEN 'expand_search relax_filters multi_query' WHEN confidence >= 0.8 THEN '' ELSE array_to_string(list_filter([CASE WHEN mean < 0.4 THEN 'multi_query' END, CASE WHEN mean < 0.4 THEN 'switch_strategy' END, CASE WHEN decay > 0.7 THEN 'broader_context' END, CASE WHEN decay > 0.7 THEN 'graph_expansion' END,
        CASE WHEN best < 0.5 AND exact THEN 'full_text_search' END, CASE WHEN best < 0.5 AND NOT exact AND NOT mean < 0.4 THEN 'switch_strategy' END, CASE WHEN best < 0.5 AND NOT exact AND NOT mean < 0.4 THEN 'multi_query' END,
        CASE WHEN kind = 'multi_hop' AND NOT decay > 0.7 THEN 'graph_expansion' END, CASE WHEN kind = 'exact_match' AND NOT best < 0.5 THEN 'full_text_search' END, CASE WHEN kind = 'aggregative' THEN 'expand_search' END], lambda x: x IS NOT NULL)[1:3], ' ') END AS fallbacks FROM c""",
)
def _(s, d):
    """Queries divisible by 400 come back without a row."""
    k = vectors(s, d).filter("chunk_id % 100 = 0")
    kinds = k.select(F.col("chunk_id").alias("query_id"), F.when(F.col("label") % 4 == 0, "aggregative").when(F.col("label") % 4 == 1, "multi_hop").when(F.col("label") % 4 == 2, "exact_match").otherwise("factoid").alias("kind"), (F.col("label") % 4 == 2).alias("requires_exact"))
    g = understanding.grade(vector_run(s, d, 10).filter("query_id % 400 <> 0"), queries=kinds)
    return g.select("query_id", "confidence", "level", F.array_join("issues", " ").alias("issues"), F.array_join("fallbacks", " ").alias("fallbacks"))


SQL["eval_compare"] = f"""WITH {V}, q AS (SELECT vec_id AS query_id, label FROM v WHERE vec_id % 100 = 0), rel AS (SELECT q.query_id, v.vec_id AS chunk_id FROM q JOIN v USING (label) WHERE v.vec_id <> q.query_id), nr AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
    u AS (SELECT 'cosine' AS strategy, query_id, chunk_id, rank FROM a WHERE rank <= 10 UNION ALL SELECT 'half', query_id, chunk_id, rank FROM b WHERE rank <= 10),
    j AS (SELECT u.*, CASE WHEN rel.chunk_id IS NULL THEN 0 ELSE 1 END AS rel FROM u LEFT JOIN rel USING (query_id, chunk_id)), c AS (SELECT *, sum(rel) OVER (PARTITION BY strategy, query_id ORDER BY rank) AS sofar FROM j),
    m AS (SELECT strategy, query_id, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(CASE WHEN rel = 1 THEN sofar / rank END) AS aps, sum(rel / log2(rank + 1)) AS dcg FROM c GROUP BY ALL)
    SELECT strategy, round(avg(coalesce(1.0 / first, 0)), 4) AS mrr, round(avg(coalesce(aps / n, 0)), 4) AS map, round(avg(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 10) + 1) t(i)), 0)), 4) AS ndcg_10 FROM m LEFT JOIN nr USING (query_id) GROUP BY 1"""

SQL["extractive_summary"] = r"""WITH p AS (SELECT doc_id, filename, list_filter(list_transform(string_split(text, '. '), lambda s: trim(s, ' ')), lambda s: s <> '') AS l FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, filename || '.' AS t, list_transform(l[1:3], lambda s: CASE WHEN ends_with(s, '.') THEN s ELSE s || '.' END) AS s FROM p)
    SELECT doc_id, substring(CASE WHEN len(s) = 0 THEN t WHEN len(s) = 1 OR length(t || ' ' || s[1]) > 600 THEN t || ' ' || s[1] WHEN len(s) = 2 OR length(t || ' ' || s[1] || ' ' || s[2]) > 600 THEN t || ' ' || s[1] || ' ' || s[2] ELSE t || ' ' || s[1] || ' ' || s[2] || ' ' || s[3] END, 1, 500) AS summary FROM s"""

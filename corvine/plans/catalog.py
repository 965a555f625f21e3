"""All queries by name and, where SQL can express them, the same in SQL.

Every query runs over its whole tables. Vector queries are the rows of
``embeddings`` whose id is divisible by 100, against all rows; text queries are
all rows of ``eval_items``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions import columns as C
from corvine.operators import chunking, context, evaluation, filters, graph, ingest, ranked, search, telemetry, understanding
from corvine.storage import read_table
from corvine.streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


# Ranked lists the queries work on.


def vectors(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_run(s: SparkSession, d: str, k: int, offset: int = 0) -> DataFrame:
    v = vectors(s, d)
    q = v.filter(F.pmod("chunk_id", F.lit(100)) == offset).select(F.col("chunk_id").alias("query_id"), "embedding")
    return search.vector_top_k(v, q, k, exclude_self=True)


def other_run(s: SparkSession, d: str, k: int) -> DataFrame:
    """A second ranking of the same queries: by distance on the vectors' first half."""
    v = vectors(s, d).withColumn("embedding", F.slice("embedding", 1, 32))
    q = v.filter(F.pmod("chunk_id", F.lit(100)) == 0).select(F.col("chunk_id").alias("query_id"), "embedding")
    return search.vector_top_k(v, q, k, metric="l2", exclude_self=True)


V = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
    pair AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(q.e, c.e) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
    a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pair),
    half AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, 1 / (1 + list_distance(q.e[1:32], c.e[1:32])) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM half)"""


@query("vector_topk_cosine", f"WITH {V} SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM a WHERE rank <= 10")
def _(s, d):
    return rounded(vector_run(s, d, 10), "score")


@query("vector_topk_l2", f"WITH {V} SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM b WHERE rank <= 10")
def _(s, d):
    return rounded(other_run(s, d, 10), "score")


@query(
    "vector_topk_filtered",
    f"WITH {V}, f AS (SELECT p.query_id, p.chunk_id, p.score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pair p JOIN v ON v.vec_id = p.chunk_id WHERE v.label IN (1, 3, 5)) SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM f WHERE rank <= 10",
)
def _(s, d):
    v = vectors(s, d)
    q = v.filter(F.pmod("chunk_id", F.lit(100)) == 0).select(F.col("chunk_id").alias("query_id"), "embedding")
    return rounded(search.vector_top_k(v.filter(F.col("label").isin(1, 3, 5)), q, 10, exclude_self=True), "score")


@query("similarity_floor", f"WITH {V} SELECT query_id, chunk_id, round(score, 4) AS score FROM a WHERE rank <= 20 AND score >= 0.3")
def _(s, d):
    return rounded(ranked.floor_by(vector_run(s, d, 20), 0.3), "score").drop("rank")


@query("minmax_normalize", f"WITH {V}, t AS (SELECT * FROM a WHERE rank <= 20), m AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM t) SELECT query_id, chunk_id, round(CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE (score - lo) / (hi - lo) END, 4) AS score, rank FROM m")
def _(s, d):
    return rounded(ranked.min_max(vector_run(s, d, 20)), "score")


@query("zscore_normalize", f"WITH {V}, t AS (SELECT * FROM a WHERE rank <= 20), m AS (SELECT *, avg(score) OVER (PARTITION BY query_id) AS mu, stddev_pop(score) OVER (PARTITION BY query_id) AS sd FROM t) SELECT query_id, chunk_id, round(CASE WHEN sd < 1e-12 THEN 1.0 ELSE 1 / (1 + exp(-(score - mu) / sd)) END, 4) AS score, rank FROM m")
def _(s, d):
    return rounded(ranked.z_score(vector_run(s, d, 20)), "score")


F2 = "u AS (SELECT query_id, chunk_id, rank, score FROM a WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, rank, score FROM b WHERE rank <= 20)"


@query("rrf_fusion", f"WITH {V}, {F2}, g AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score FROM u GROUP BY ALL) SELECT query_id, chunk_id, round(score, 6) AS score FROM g")
def _(s, d):
    return rounded(ranked.reciprocal_rank_fusion([vector_run(s, d, 20), other_run(s, d, 20)]), "score", places=6).drop("rank")


@query("max_normalize", f"WITH {V}, {F2}, g AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score FROM u GROUP BY ALL) SELECT query_id, chunk_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM g")
def _(s, d):
    return rounded(ranked.max_scaled(ranked.reciprocal_rank_fusion([vector_run(s, d, 20), other_run(s, d, 20)])), "score", places=6).drop("rank")


def _fuse(norm: str) -> str:
    n = lambda t: f"n{t} AS (SELECT query_id, chunk_id, {norm} AS s FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, avg(score) OVER w AS mu, stddev_pop(score) OVER w AS sd FROM {t} WHERE rank <= 20 WINDOW w AS (PARTITION BY query_id)))"
    return f"WITH {V}, {n('a')}, {n('b')} SELECT query_id, chunk_id, round(0.7 * coalesce(na.s, 0) + 0.3 * coalesce(nb.s, 0), 4) AS score FROM na FULL JOIN nb USING (query_id, chunk_id)"


@query("hybrid_minmax", _fuse("CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE (score - lo) / (hi - lo) END"))
def _(s, d):
    return rounded(ranked.weighted_fusion(vector_run(s, d, 20), other_run(s, d, 20), 0.7), "score").drop("rank")


@query("hybrid_zscore", _fuse("CASE WHEN sd < 1e-12 THEN 1.0 ELSE 1 / (1 + exp(-(score - mu) / sd)) END"))
def _(s, d):
    return rounded(ranked.weighted_fusion(vector_run(s, d, 20), other_run(s, d, 20), 0.7, ranked.z_score), "score").drop("rank")


@query("multi_query_max", f"WITH {V}, {F2} SELECT query_id, chunk_id, round(max(score), 4) AS score FROM u GROUP BY ALL")
def _(s, d):
    return rounded(ranked.max_merge([vector_run(s, d, 20), other_run(s, d, 20)]), "score").drop("rank")


@query(
    "hyde_average",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
    x AS (SELECT label, unnest(range(1, 65)) AS i, e FROM v), m AS (SELECT label, i, avg(e[i]) AS x FROM x GROUP BY ALL),
    h AS (SELECT label AS query_id, list(x ORDER BY i) AS e FROM m GROUP BY label),
    r AS (SELECT h.query_id, v.vec_id AS chunk_id, list_cosine_similarity(h.e, v.e) AS score FROM h, v),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM r)
    SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM t WHERE rank <= 10""",
)
def _(s, d):
    v = vectors(s, d)
    e = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    q = e.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))
    return rounded(search.vector_top_k(v, q, 10), "score")


BM = r"""t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
    tf AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t), tc AS (SELECT doc_id, dl, term, count(*) AS tf FROM tf GROUP BY ALL),
    n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t), df AS (SELECT term, count(*) AS df FROM tc GROUP BY term),
    i0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS i FROM df, n), i AS (SELECT term, CASE WHEN i < 0 THEN 0.25 * (SELECT avg(i) FROM i0) ELSE i END AS idf FROM i0),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS term FROM eval_items) GROUP BY ALL),
    sc AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM q JOIN i USING (term) JOIN tc USING (term), n GROUP BY item_id, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc)"""


def bm25_run(s, d, k):
    docs = read_table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    items = read_table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25(docs, items, k)


@query("bm25_corpus_topk", f"WITH {BM} SELECT query_id, chunk_id, round(score, 3) AS score FROM r WHERE rank <= 5")
def _(s, d):
    return rounded(bm25_run(s, d, 5), "score", places=3).drop("rank")


@query("confidence_grade")
def _(s, d):
    return understanding.grade(vector_run(s, d, 10)).select("query_id", "confidence", "level")


SQL["confidence_grade"] = f"""WITH {V}, g AS (SELECT query_id, max(score) AS best, stddev_pop(score) AS sd, count(*) AS n, max(CASE WHEN rank = 2 THEN score END) AS b2, max(CASE WHEN rank = 3 THEN score END) AS b3 FROM a WHERE rank <= 10 GROUP BY query_id),
    c AS (SELECT query_id, round(0.30 * CASE WHEN best < 0.5 THEN 0.3 WHEN best < 0.7 THEN 0.6 ELSE 1.0 END + 0.20 * CASE WHEN n < 2 THEN 0.5 WHEN sd < 0.05 THEN 0.4 WHEN sd < 0.15 THEN 0.7 ELSE 1.0 END
      + 0.20 * CASE WHEN b2 IS NULL THEN 0.5 WHEN best - b2 > 0.2 THEN 1.0 WHEN best - b2 > 0.1 THEN 0.7 WHEN best - b2 < 0.03 THEN 0.3 ELSE 0.5 END + 0.15 * CASE WHEN n < 3 THEN 0.4 WHEN n < 6 THEN 0.7 ELSE 1.0 END
      + 0.15 * CASE WHEN b3 IS NULL THEN 0.5 WHEN (best - b3) / greatest(best, 0.01) > 0.7 THEN 0.4 WHEN (best - b3) / greatest(best, 0.01) < 0.3 THEN 1.0 ELSE 0.7 END, 6) AS confidence FROM g)
    SELECT query_id, confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.2 THEN 'low' ELSE 'very_low' END AS level FROM c"""


def judged_sets(s, d):
    """Vectors of the query's label are relevant to it."""
    v = vectors(s, d)
    q = v.filter(F.pmod("chunk_id", F.lit(100)) == 0).select(F.col("chunk_id").alias("query_id"), "label")
    return q, q.join(v.select("chunk_id", "label"), "label").filter("query_id <> chunk_id").select("query_id", "chunk_id")


@query(
    "eval_metrics",
    f"""WITH {V}, q AS (SELECT vec_id AS query_id, label FROM v WHERE vec_id % 100 = 0), rel AS (SELECT q.query_id, v.vec_id AS chunk_id FROM q JOIN v USING (label) WHERE v.vec_id <> q.query_id),
    nr AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id), j AS (SELECT a.query_id, a.rank, CASE WHEN rel.chunk_id IS NULL THEN 0 ELSE 1 END AS rel FROM a LEFT JOIN rel USING (query_id, chunk_id) WHERE a.rank <= 10),
    c AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS sofar FROM j),
    m AS (SELECT query_id, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(CASE WHEN rel = 1 THEN sofar / rank END) AS aps, sum(CASE WHEN rank <= 5 THEN rel END) AS h5, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) END) AS dcg FROM c GROUP BY query_id)
    SELECT q.query_id, round(coalesce(1.0 / first, 0), 4) AS rr, round(coalesce(aps / n, 0), 4) AS ap, round(coalesce(h5 / 5.0, 0), 4) AS p_5, round(coalesce(h5 / n, 0), 4) AS r_5,
      round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 10) + 1) t(i)), 0), 4) AS ndcg_10 FROM q LEFT JOIN m USING (query_id) LEFT JOIN nr USING (query_id)""",
)
def _(s, d):
    q, rel = judged_sets(s, d)
    m = evaluation.metrics(vector_run(s, d, 10), rel, q, (5, 10))
    return rounded(m.select("query_id", "rr", "ap", "p_5", "r_5", "ndcg_10"), "rr", "ap", "p_5", "r_5", "ndcg_10")


@query("eval_compare")
def _(s, d):
    q, rel = judged_sets(s, d)
    runs = vector_run(s, d, 10).withColumn("strategy", F.lit("cosine")).unionByName(other_run(s, d, 10).withColumn("strategy", F.lit("half")))
    return rounded(evaluation.compare(runs, rel, q), "mrr", "map", "ndcg_10")


@query("mmr_diversify")
def _(s, d):
    return rounded(context.diversify(vector_run(s, d, 20).join(vectors(s, d).select("chunk_id", "embedding"), "chunk_id"), 10), "score")


# Text, chunks and ingest.


@query("exact_dedup_hash", "SELECT sha256(text) AS hash, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return ingest.exact_duplicates(read_table(s, d, "documents"), "text")


@query("language_distribution", "SELECT coalesce(nullif(regexp_extract(lower(lang), '^\\s*([a-z]+)', 1), ''), 'none') AS lang, count(*) AS n FROM documents GROUP BY 1")
def _(s, d):
    lang = F.coalesce(F.nullif(F.regexp_extract(F.lower("lang"), r"^\s*([a-z]+)", 1), F.lit("")), F.lit("none"))
    return read_table(s, d, "documents").groupBy(lang.alias("lang")).agg(F.count("*").alias("n"))


CHUNK = "c AS (SELECT DISTINCT chunk_id, collection_id, filename, chunk_index, content FROM chunks)"


def distinct_chunks(s, d):
    return read_table(s, d, "chunks").select("chunk_id", "collection_id", "filename", "chunk_index", "content").distinct()


@query("token_statistics", f"WITH {CHUNK} SELECT collection_id, count(*) AS n, CAST(sum(length(content) // 4) AS BIGINT) AS tokens, max(length(content) // 4) AS longest FROM c GROUP BY 1")
def _(s, d):
    c = distinct_chunks(s, d).withColumn("t", C.token_count(F.col("content")))
    return c.groupBy("collection_id").agg(F.count("*").alias("n"), F.sum("t").alias("tokens"), F.max("t").alias("longest"))


@query("token_budget_prefix")
def _(s, d):
    c = distinct_chunks(s, d).select(F.col("filename").alias("query_id"), "chunk_id", (1.0 / (1 + F.col("chunk_index"))).alias("score"), F.col("content").alias("text"))
    return context.within_budget(c, 400).select("query_id", "chunk_id", "n_tokens", F.round("score", 6).alias("score"))


SQL["token_budget_prefix"] = f"""WITH {CHUNK}, r AS (SELECT filename AS query_id, chunk_id, 1.0 / (1 + chunk_index) AS score, content, length(content) // 4 AS n FROM c),
    s AS (SELECT *, sum(n) OVER w AS run FROM r WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, chunk_id ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT *, coalesce(lag(run > 400) OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id), false) AS earlier, 400 - (run - n) AS room FROM s),
    k AS (SELECT *, content[1 : CAST(room * 4 AS BIGINT)] AS cut FROM l WHERE (run <= 400 OR NOT earlier) AND (run <= 400 OR room > 100)),
    z AS (SELECT *, length(cut) - instr(reverse(cut), '.') + 1 AS stop FROM k)
    SELECT query_id, CASE WHEN run > 400 THEN chunk_id || '_truncated' ELSE chunk_id END AS chunk_id, round(score, 6) AS score,
      CAST((CASE WHEN run <= 400 THEN length(content) WHEN instr(cut, '.') > 0 AND stop >= 0.7 * length(cut) THEN stop ELSE length(cut) END) // 4 AS INT) AS n_tokens FROM z"""


@query("sentence_extraction")
def _(s, d):
    c = distinct_chunks(s, d)
    return context.relevant_sentences(c.select(F.col("filename").alias("query_id"), "chunk_id", F.lit("the longest paragraph of the report").alias("query"), F.col("content").alias("text")))


@query("pinned_injection")
def _(s, d):
    c = distinct_chunks(s, d)
    first = c.filter("chunk_index = 0").select("collection_id", "filename").groupBy("collection_id").agg(F.min("filename").alias("filename"))
    pinned = c.join(first, ["collection_id", "filename"]).select(F.col("collection_id").alias("query_id"), "chunk_id", "filename", F.lit(0).alias("file_order"), "chunk_index", F.col("content").alias("text"))
    own = ranked.top_k(c.select(F.col("collection_id").alias("query_id"), "chunk_id", "filename", (F.length("content") / 100000.0).alias("score")), 10)
    return rounded(context.inject_pinned(own, pinned), "score", places=5)


@query("semantic_chunks")
def _(s, d):
    return chunking.chunk_documents(read_table(s, d, "documents").select("filename", "text"))


@query("parent_child")
def _(s, d):
    return chunking.parents(chunking.chunk_documents(read_table(s, d, "documents").select("filename", "text")).select("filename", "chunk_index", "n_tokens"))


REG = "r AS (SELECT DISTINCT ON (entry_id) entry_id, batch_id, collection_id, filename, file_hash, chunk_hashes FROM doc_registry ORDER BY entry_id, ingested_at, file_hash)"


@query(
    "registry_upsert",
    "SELECT collection_id, filename, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY collection_id, filename ORDER BY entry_id DESC) AS n FROM (SELECT DISTINCT collection_id, filename, entry_id FROM doc_registry)) WHERE n = 1",
)
def _(s, d):
    r = read_table(s, d, "doc_registry").select("collection_id", "filename", "entry_id", "batch_id").distinct()
    old = ingest.latest(r.filter("batch_id = 0"), ["collection_id", "filename"], [F.desc("entry_id")])
    new = ingest.latest(r.filter("batch_id > 0"), ["collection_id", "filename"], [F.desc("entry_id")])
    return ingest.upsert(old, new, ["collection_id", "filename"]).select("collection_id", "filename", "entry_id")


def _hashes(r: DataFrame) -> DataFrame:
    return r.select("collection_id", "filename", F.explode_outer(F.map_values(F.from_json("chunk_hashes", "map<string,string>"))).alias("hash"))


@query(
    "chunk_diff_plan",
    """WITH h AS (SELECT DISTINCT collection_id, filename, batch_id > 0 AS new, unnest(json_extract_string(chunk_hashes, '$.*')) AS hash FROM doc_registry WHERE chunk_hashes IS NOT NULL),
    o AS (SELECT * FROM h WHERE NOT new), n AS (SELECT * FROM h WHERE new),
    f AS (SELECT coalesce(o.collection_id, n.collection_id) AS collection_id, coalesce(o.filename, n.filename) AS filename, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' ELSE 'unchanged' END AS state
      FROM o FULL JOIN n ON o.collection_id = n.collection_id AND o.filename = n.filename AND o.hash = n.hash)
    SELECT collection_id, state, count(*) AS n FROM f GROUP BY ALL""",
)
def _(s, d):
    r = read_table(s, d, "doc_registry")
    diff = ingest.chunk_diff(_hashes(r.filter("batch_id = 0")), _hashes(r.filter("batch_id > 0")), ["collection_id", "filename"])
    return diff.groupBy("collection_id", "state").agg(F.count("*").alias("n"))


@query("orphan_sweep", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status FROM ingest_jobs) GROUP BY 1")
def _(s, d):
    return ingest.sweep_orphans(read_table(s, d, "ingest_jobs")).groupBy("status").agg(F.count("*").alias("n"))


@query("latest_jobs", "SELECT job_id, max(updated_at) AS updated_at FROM ingest_jobs GROUP BY 1")
def _(s, d):
    return ingest.latest(read_table(s, d, "ingest_jobs"), ["job_id"], [F.desc("updated_at")]).select("job_id", "updated_at")


@query("delete_anti_join", f"WITH {CHUNK} SELECT filename, count(*) AS n FROM c WHERE filename NOT IN (SELECT filename FROM documents WHERE doc_type = 'csv') GROUP BY 1")
def _(s, d):
    gone = read_table(s, d, "documents").filter("doc_type = 'csv'").select("filename")
    return ingest.delete(distinct_chunks(s, d), gone, ["filename"]).groupBy("filename").agg(F.count("*").alias("n"))


@query("collection_stats", "SELECT collection_id, count(DISTINCT filename) AS file_count, count(DISTINCT chunk_id) AS chunk_count FROM chunks GROUP BY 1")
def _(s, d):
    return ingest.collection_stats(read_table(s, d, "chunks"))


@query("metadata_filter_ops", "SELECT doc_id FROM documents WHERE n_chars >= 500 AND n_chars < 3000 AND doc_type IN ('pdf', 'markdown') AND lower(filename) LIKE '%ban%' AND source <> 'archive'")
def _(s, d):
    spec = {"n_chars": {"$gte": 500, "$lt": 3000}, "doc_type": {"$in": ["pdf", "markdown"]}, "filename": "ban", "source": {"$ne": "archive"}}
    docs = read_table(s, d, "documents")
    return docs.filter(filters.predicate(spec, F.col, dict(docs.dtypes))).select("doc_id")


@query("json_metadata_filter", "SELECT DISTINCT chunk_id FROM chunks WHERE CAST(json_extract_string(metadata, '$.page_number') AS DOUBLE) > 2 AND regexp_matches(json_extract_string(metadata, '$.title'), '(?i)report|review') AND json_extract_string(metadata, '$.language') = 'en'")
def _(s, d):
    spec = {"page_number": {"$gt": 2}, "title": {"$regex": "report|review"}, "language": "en"}
    return read_table(s, d, "chunks").filter(filters.predicate(spec, filters.json_field("metadata"))).select("chunk_id").distinct()


@query("jaccard_to_items")
def _(s, d):
    items = read_table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    top = bm25_run(s, d, 5).join(read_table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id").join(items, "query_id")
    j = C.jaccard(F.array_distinct(C.word_tokens(F.col("query"))), F.array_distinct(C.word_tokens(F.col("text"))))
    return top.select("query_id", "chunk_id", F.round(j, 4).alias("jaccard"))


SQL["jaccard_to_items"] = rf"""WITH {BM}, x AS (SELECT r.query_id, r.chunk_id, list_distinct(regexp_extract_all(lower(e.text), '[\p{{L}}\p{{N}}_]+')) AS a, list_distinct(regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}_]+')) AS b
    FROM r JOIN eval_items e ON e.item_id = r.query_id JOIN documents d ON d.doc_id = r.chunk_id WHERE r.rank <= 5)
    SELECT query_id, chunk_id, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 4) AS jaccard FROM x"""


@query("lexical_grounding")
def _(s, d):
    items = read_table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("answer"))
    top = bm25_run(s, d, 1).join(read_table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id").join(items, "query_id")
    return top.select("query_id", F.round(understanding.lexical_grounding(F.col("answer"), F.col("text")), 4).alias("grounding"))


SQL["lexical_grounding"] = rf"""WITH {BM}, x AS (SELECT r.query_id, list_distinct(regexp_extract_all(lower(e.text), '[\p{{L}}\p{{N}}_]+')) AS a, regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}_]+') AS b
    FROM r JOIN eval_items e ON e.item_id = r.query_id JOIN documents d ON d.doc_id = r.chunk_id WHERE r.rank <= 1)
    SELECT query_id, round(len(list_intersect(a, b)) / len(a), 4) AS grounding FROM x"""


# Queries as text.


@query("adaptive_alpha")
def _(s, d):
    i = read_table(s, d, "eval_items")
    a = F.round(understanding.adaptive_alpha(F.col("text")), 4)
    return i.select("item_id", a.alias("alpha"), understanding.alpha_band(a).alias("band"))


@query("rule_router")
def _(s, d):
    return read_table(s, d, "eval_items").select("item_id", understanding.route(F.col("text")).alias("route"))


@query("extractive_summary")
def _(s, d):
    return read_table(s, d, "documents").filter("text is not null").select("doc_id", understanding.extractive_summary(F.col("text"), F.col("filename")).alias("summary"))


SQL["adaptive_alpha"] = r"""WITH q AS (SELECT item_id, text, lower(text) AS low, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n,
      len(list_filter(regexp_extract_all(text, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b'), lambda x: lower(x) NOT IN ('what', 'why', 'how', 'which', 'when', 'where', 'who'))) AS names FROM eval_items),
    a AS (SELECT item_id, 0.7 + CASE WHEN n > 12 THEN 0.10 WHEN n > 8 THEN 0.05 WHEN n <= 3 THEN -0.10 ELSE 0 END
      + CASE WHEN regexp_matches(low, '\b(what|why|how|which|when|where|who|explain|describe|compare)\b') THEN 0.10 ELSE 0 END
      + CASE WHEN regexp_matches(low, '"[^"]+"|\b(id|code|number|version|sku|isbn)\b') THEN -0.20 ELSE 0 END
      + CASE WHEN regexp_matches(text, '\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b|\b\w+_\w+\b|\b\w+-\w+\b') THEN -0.10 ELSE 0 END
      + CASE WHEN names >= 2 THEN 0.08 ELSE 0 END + CASE WHEN regexp_matches(text, '\b\d+\.?\d*\b') THEN -0.08 ELSE 0 END + CASE WHEN regexp_matches(text, '"[^"]+"') THEN -0.15 ELSE 0 END AS a FROM q),
    c AS (SELECT item_id, round(CAST(greatest(0.2, least(0.95, a)) AS DOUBLE), 4) AS alpha FROM a)
    SELECT item_id, alpha, CASE WHEN alpha >= 0.8 THEN 'semantic' WHEN alpha >= 0.6 THEN 'mostly semantic' WHEN alpha >= 0.4 THEN 'balanced' WHEN alpha >= 0.25 THEN 'mostly keyword' ELSE 'keyword' END AS band FROM c"""

SQL["rule_router"] = r"""WITH q AS (SELECT item_id, text, lower(text) AS low, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM eval_items),
    f AS (SELECT *, len(w) AS n, regexp_matches(low, 'what|which|how|why|when|where|who') AS asks,
      len(regexp_extract_all(text, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+')) + len(regexp_extract_all(text, '\b(?:CEO|CTO|CFO|President|Director)\b')) + len(regexp_extract_all(text, '\b(?:Inc\.|Corp\.|LLC|Ltd\.)\b')) AS names FROM q)
    SELECT item_id, CASE
      WHEN regexp_matches(low, '\b(and|after|before)\b.*\b(what|how|why|when|where|who)|\b(relate|connect|compare|contrast)|difference between|relationship between|impact of.*on') THEN 'multi_hop'
      WHEN names >= 2 THEN 'entity_centric'
      WHEN regexp_matches(low, '\b(explore|investigate|find out|tell me about|learn about|understand|overview|summary|explain)\b') THEN 'exploratory'
      WHEN (n <= 3 AND NOT asks) OR (n BETWEEN 2 AND 5 AND NOT asks AND NOT list_has_any(w, ['is', 'are', 'was', 'were', 'do', 'does', 'did', 'can', 'will', 'should'])) THEN 'vague_or_sparse'
      WHEN (n > 10 AND asks) OR list_has_any(w, ['how', 'why']) THEN 'factual_complex' ELSE 'factual_simple' END AS route FROM f"""


SQL["sentence_extraction"] = rf"""WITH {CHUNK}, s AS (SELECT filename AS query_id, chunk_id, string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM c),
    e AS (SELECT query_id, chunk_id, unnest(range(0, len(l))) AS pos, unnest(l) AS sentence FROM s),
    o AS (SELECT *, len(list_intersect(['the', 'longest', 'paragraph', 'of', 'report'], list_filter(regexp_split_to_array(lower(sentence), '\s+'), lambda x: x <> ''))) AS overlap FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY overlap DESC, pos) AS rank FROM o)
    SELECT query_id, chunk_id, pos, sentence, overlap, rank FROM r WHERE rank <= 5"""





# Graph.


def mentions(s, d):
    return graph.entities(distinct_chunks(s, d).select("chunk_id", F.col("content").alias("text")))


MENTION = r"""c AS (SELECT DISTINCT chunk_id, content FROM chunks), m0 AS (SELECT chunk_id, list_transform(regexp_extract_all(content, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b'), lambda x: regexp_replace(x, '\s+', ' ', 'g')) AS l FROM c),
    m1 AS (SELECT chunk_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:10] AS l FROM m0), m AS (SELECT DISTINCT chunk_id, unnest(l) AS name FROM m1)"""


@query("entity_counts", f"WITH {MENTION} SELECT name, count(DISTINCT chunk_id) AS chunks FROM m GROUP BY 1 HAVING count(DISTINCT chunk_id) >= 2")
def _(s, d):
    return graph.kept_entities(mentions(s, d))


EDGE = f"WITH {MENTION}, e AS (SELECT a.name AS src, b.name AS dst, count(*) AS weight FROM m a JOIN m b USING (chunk_id) WHERE a.name <> b.name GROUP BY ALL)"


@query("cooccurrence_edges", f"{EDGE} SELECT src, dst, weight FROM e")
def _(s, d):
    return graph.co_occurrence(mentions(s, d))


@query("graph_expand_bfs", f"{EDGE}, z AS (SELECT min(src) AS name FROM e), h1 AS (SELECT DISTINCT dst AS name FROM e JOIN z ON src = name), h2 AS (SELECT DISTINCT dst AS name FROM e JOIN h1 ON src = name) SELECT name, min(h) AS hops FROM (SELECT name, 0 AS h FROM z UNION ALL SELECT name, 1 FROM h1 UNION ALL SELECT name, 2 FROM h2) GROUP BY 1")
def _(s, d):
    e = graph.co_occurrence(mentions(s, d))
    return graph.expand(e, e.agg(F.min("src").alias("name")), 2)


@query("pagerank_fixed_iter")
def _(s, d):
    return rounded(graph.page_rank(graph.co_occurrence(mentions(s, d)), 8), "importance", places=8)


@query("entity_centroids")
def _(s, d):
    v = read_table(s, d, "chunk_vectors").filter(F.size("embedding") == 64).dropDuplicates(["chunk_id"])
    return graph.centroids(mentions(s, d), v).select("name", F.round(F.col("embedding")[0], 4).alias("first"), F.size("embedding").alias("dim"))


# Logs and events.


@query("query_analytics", "SELECT user_id, count(*) AS n, min(event_type) AS event_type FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
def _(s, d):
    return telemetry.frequent(read_table(s, d, "events"), "user_id", "event_type", 20)


@query("performance_metrics", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(avg(CASE WHEN value > 0 THEN value END), 4) AS mean_positive, count(*) FILTER (value > 0) AS n_positive FROM events GROUP BY 1")
def _(s, d):
    return rounded(telemetry.averages(read_table(s, d, "events"), "event_type", "value"), "mean", "mean_positive")


@query("recent_n_per_group", "SELECT user_id, event_id, back FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 4")
def _(s, d):
    return telemetry.recent(read_table(s, d, "events"), "user_id", "ts", "event_id", 4).select("user_id", "event_id", "back")


@query(
    "low_confidence_join",
    """WITH q AS (SELECT event_id AS query_id, user_id AS query_hash FROM events WHERE event_type = (SELECT min(event_type) FROM events)), r AS (SELECT event_id AS retrieval_id, user_id AS query_hash, value AS confidence FROM events WHERE event_type = (SELECT max(event_type) FROM events))
    SELECT query_hash, query_id, retrieval_id, round(confidence, 6) AS confidence FROM q JOIN r USING (query_hash) WHERE confidence < 5 ORDER BY confidence, query_hash, query_id, retrieval_id LIMIT 50""",
)
def _(s, d):
    """Events of the first kind stand for queries, those of the last for retrievals; users for hashes."""
    e = read_table(s, d, "events")
    kinds = e.agg(F.min("event_type"), F.max("event_type")).first()
    q = e.filter(F.col("event_type") == kinds[0]).select(F.col("event_id").alias("query_id"), F.col("user_id").alias("query_hash"))
    r = e.filter(F.col("event_type") == kinds[1]).select(F.col("event_id").alias("retrieval_id"), F.col("user_id").alias("query_hash"), F.col("value").alias("confidence"))
    return telemetry.low_confidence(q, r, 5, 50).select("query_hash", "query_id", "retrieval_id", F.round("confidence", 6).alias("confidence"))


@query("doc_type_distribution", "SELECT doc_type, count(*) AS n, count(DISTINCT collection_id) AS collections FROM documents WHERE doc_type IS NOT NULL GROUP BY 1")
def _(s, d):
    return read_table(s, d, "documents").filter("doc_type is not null").groupBy("doc_type").agg(F.count("*").alias("n"), F.count_distinct("collection_id").alias("collections"))


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    return rounded(flows.windowed_counts(read_table(s, d, "events")), "total")


@query("event_sessions")
def _(s, d):
    return flows.sessions(read_table(s, d, "events"))


SQL["event_sessions"] = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS n FROM n GROUP BY user_id, k"""


@query("last_events_per_user", "SELECT user_id, string_agg(event_type, ' ' ORDER BY back) AS turns FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 4 GROUP BY 1")
def _(s, d):
    r = telemetry.recent(read_table(s, d, "events"), "user_id", "ts", "event_id", 4)
    return r.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("back", "event_type"))), lambda x: x["event_type"]), " ").alias("turns"))


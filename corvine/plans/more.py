"""Queries of the graph, tables in texts, names by domain, structure of chunks,
and the SQL of queries that had none."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvine.functions import columns as C
from corvine.operators import chunking, context, encode, graph, ingest, names, ranked, retrieval, tables, telemetry
from corvine.plans.catalog import CHUNK, EDGE, MENTION, SQL, V, distinct_chunks, mentions, query, rounded, vector_run, vectors
from corvine.storage import materialize, read_table


# Graph.


def page_rank_sql(rounds: int, damping: float = 0.85) -> str:
    """The rounds one after another, over the edges ``e``."""
    parts = [
        "w AS (SELECT src, sum(weight) AS total FROM e GROUP BY 1)",
        "pe AS (SELECT e.src, e.dst, e.weight / w.total AS p FROM e JOIN w USING (src))",
        "nm AS (SELECT src AS name FROM e UNION SELECT dst FROM e)",
        "nn AS (SELECT count(*) AS n FROM nm)",
        "r0 AS (SELECT name, 1.0 / n AS x FROM nm, nn)",
    ]
    for k in range(1, rounds + 1):
        parts.append(f"f{k} AS (SELECT dst AS name, sum(x * p) AS y FROM r{k - 1} JOIN pe ON src = name GROUP BY 1)")
        parts.append(f"l{k} AS (SELECT coalesce(sum(x), 0) AS y FROM r{k - 1} WHERE name NOT IN (SELECT src FROM e))")
        parts.append(f"r{k} AS (SELECT nm.name, {1 - damping} / n + {damping} * (coalesce(f{k}.y, 0) + l{k}.y / n) AS x FROM nm CROSS JOIN nn CROSS JOIN l{k} LEFT JOIN f{k} ON f{k}.name = nm.name)")
    return ", ".join(parts)


SQL["pagerank_fixed_iter"] = f"{EDGE}, {page_rank_sql(8)} SELECT name, round(x, 8) AS importance FROM r8"


@query("graph_top_names", f"{EDGE}, {page_rank_sql(8)}, cc AS (SELECT name, count(DISTINCT chunk_id) AS chunks FROM m GROUP BY 1) SELECT name, round(x, 8) AS importance, chunks FROM (SELECT *, round(x, 10) AS y FROM r8 JOIN cc USING (name)) ORDER BY y DESC, chunks DESC, name LIMIT 10")
def _(s, d):
    m = mentions(s, d)
    r = graph.page_rank(graph.co_occurrence(m), 8).withColumn("importance", F.round("importance", 10))
    return rounded(graph.top_names(r, m), "importance", places=8)


@query("graph_statistics", f"{EDGE} SELECT (SELECT count(DISTINCT name) FROM m) AS names, (SELECT count(DISTINCT chunk_id) FROM m) AS chunks, (SELECT count(*) FROM m) AS mentions, (SELECT count(*) FROM e WHERE src < dst) AS edges")
def _(s, d):
    m = mentions(s, d)
    return graph.statistics(m, graph.co_occurrence(m))


@query("graph_neighbours", f"{EDGE}, r AS (SELECT src AS name, dst AS neighbour, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM e) SELECT name, neighbour, weight, rank FROM r WHERE rank <= 10")
def _(s, d):
    m = mentions(s, d)
    return graph.neighbours(graph.co_occurrence(m), m.select("name"))


@query(
    "graph_trace",
    f"{EDGE}, z AS (SELECT DISTINCT src AS name FROM e), x AS (SELECT name AS query_id, name, 0 AS hops FROM z UNION ALL SELECT src, dst, 1 FROM e), "
    "b AS (SELECT a.query_id, e.src, e.dst, e.weight FROM x a JOIN e ON e.src = a.name AND e.src < e.dst JOIN x c ON c.query_id = a.query_id AND c.name = e.dst) "
    "SELECT t.query_id, t.total_names, CAST(coalesce(u.total_edges, 0) AS BIGINT) AS total_edges FROM (SELECT query_id, count(*) AS total_names FROM x GROUP BY 1) t LEFT JOIN (SELECT query_id, count(*) AS total_edges FROM b GROUP BY 1) u USING (query_id)",
)
def _(s, d):
    """Each name as a query that is expanded by one edge. Rows stored twice give the
    same names, which are told apart after the texts are gone, and the edges are
    read from a table instead of from the texts again."""
    e = materialize(graph.co_occurrence(graph.entities(read_table(s, d, "chunks").select("chunk_id", F.col("content").alias("text")))), "edges")
    x = e.select(F.col("src").alias("query_id"), F.col("src").alias("name"), F.lit(0).alias("hops")).distinct().unionByName(e.select(F.col("src").alias("query_id"), F.col("dst").alias("name"), F.lit(1).alias("hops")))
    return graph.trace(x, e).select("query_id", "total_names", "total_edges")


@query("entity_types")
def _(s, d):
    c = read_table(s, d, "chunks").select("chunk_id", F.col("content").alias("text"), F.get_json_object("metadata", "$.title").alias("title"), F.get_json_object("metadata", "$.section").alias("section")).dropDuplicates(["chunk_id", "text"])
    return graph.typed_entities(c).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


SQL["entity_centroids"] = rf"""WITH {MENTION}, v AS (SELECT chunk_id, min(CAST(embedding AS DOUBLE[])) AS e FROM chunk_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
    x AS (SELECT name, unnest(range(1, 65)) AS i, e FROM m JOIN v USING (chunk_id)), a AS (SELECT name, i, avg(e[i]) AS x FROM x GROUP BY ALL), n AS (SELECT name, sqrt(sum(x * x)) AS n, max(CASE WHEN i = 1 THEN x END) AS x FROM a GROUP BY 1)
    SELECT name, round(x / CASE WHEN n > 0 THEN n ELSE 1 END, 4) AS first, 64 AS dim FROM n"""


# Names by domain.


# Word edges of these patterns are those of all scripts, which SQL engines see differently: no SQL.


@query("domain_names_technical")
def _(s, d):
    c = distinct_chunks(s, d).select("chunk_id", F.col("content").alias("text")).distinct()
    return names.domain_names(c, "technical").select("chunk_id", "name", "kind")


@query("names_merged")
def _(s, d):
    c = distinct_chunks(s, d).select("chunk_id", F.col("content").alias("text")).distinct()
    return names.merge_names(mentions(s, d).withColumn("kind", F.lit("ENTITY")), names.domain_names(c, "technical"), "domain_first")


# Structure of chunks, models, tables.


@query(
    "structure_features",
    r"""WITH c AS (SELECT DISTINCT chunk_id, content, json_extract_string(metadata, '$.title') AS title, json_extract_string(metadata, '$.section') AS section, TRY_CAST(json_extract_string(metadata, '$.page_number') AS DOUBLE) AS page FROM chunks WHERE content IS NOT NULL)
    SELECT chunk_id, round(least(len(regexp_extract_all(content, '(?m)^#+\s')) / 5.0, 1), 4) AS headings, round(least(len(regexp_extract_all(content, '(?m)^\s*(?:[-*+]|\d+\.)\s')) / 10.0, 1), 4) AS items, CAST(contains(content, '```') AS INT) AS code, round(least(length(content) / 2000.0, 1), 4) AS size,
      CAST(title IS NOT NULL AS INT) AS titled, CAST(section IS NOT NULL AS INT) AS sectioned, round(least(coalesce(page, 0) / 100.0, 1), 4) AS page FROM c""",
)
def _(s, d):
    f = lambda k: F.get_json_object("metadata", f"$.{k}")
    c = read_table(s, d, "chunks").filter("content is not null").select("chunk_id", "content", f("title").alias("title"), f("section").alias("section"), f("page_number").try_cast("double").alias("page")).distinct()
    x = c.select("chunk_id", encode.structure(F.col("content"), F.col("title"), F.col("section"), F.col("page")).alias("f"))
    get = lambda i: F.round(F.get("f", i), 4)
    return x.select("chunk_id", get(0).alias("headings"), get(1).alias("items"), get(2).cast("int").alias("code"), get(3).alias("size"), get(5).cast("int").alias("titled"), get(6).cast("int").alias("sectioned"), get(7).alias("page"))


@query("texts_too_long", "SELECT count(*) FILTER (length(text) // 4 > 512) AS truncated, CAST(coalesce(max(length(text) // 4), 0) AS INT) AS longest FROM documents WHERE length(text) > 1024")
def _(s, d):
    return encode.too_long(read_table(s, d, "documents"), "text", 512)


@query("vectors_projected")
def _(s, d):
    p = encode.project(vectors(s, d), "chunk_id", "embedding")
    return p.select("chunk_id", F.round(F.get("point", 0), 4).alias("x"), F.round(F.get("point", 1), 4).alias("y"))


@query("hashed_embeddings")
def _(s, d):
    return encode.encode(read_table(s, d, "eval_items"), "item_id", "text", encode.hashing_encoder, "e5-small", True).select("item_id", F.size("embedding").alias("dim"))


@query("table_regions")
def _(s, d):
    return tables.detect(read_table(s, d, "documents").select("filename", "text")).select("filename", "table_no", "start_pos", "end_pos", "kind")


@query("chunks_with_tables")
def _(s, d):
    return tables.chunk_with_tables(read_table(s, d, "documents").select("filename", "text")).select("filename", "chunk_index", "total_chunks", "n_tokens", "is_table")


@query("children_of_parents")
def _(s, d):
    c = chunking.chunk_documents(read_table(s, d, "documents").select("filename", "text"))
    return chunking.children(chunking.parents(c))


@query(
    "ingest_plan",
    """WITH n AS (SELECT collection_id, filename, sha256(content) AS hash, count(*) AS n FROM (SELECT DISTINCT chunk_id, collection_id, filename, chunk_index, content FROM chunks WHERE content IS NOT NULL) GROUP BY ALL),
    o AS (SELECT DISTINCT collection_id, filename, sha256(text) AS hash FROM documents WHERE text IS NOT NULL),
    f AS (SELECT coalesce(n.collection_id, o.collection_id) AS collection_id, CASE WHEN o.hash IS NULL THEN 'embed' WHEN n.hash IS NULL THEN 'remove' ELSE 'keep' END AS action, coalesce(n.n, 1) AS n FROM n FULL JOIN o ON n.collection_id = o.collection_id AND n.filename = o.filename AND n.hash = o.hash)
    SELECT collection_id, action, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY ALL""",
)
def _(s, d):
    """Files that were one chunk each so far, now in chunks."""
    old = read_table(s, d, "documents").select("collection_id", "filename", F.sha2("text", 256).alias("hash"))
    return ingest.ingest_plan(old, distinct_chunks(s, d), ["collection_id", "filename"]).groupBy("collection_id", "action").agg(F.count("*").alias("n"))


@query("store_totals", "SELECT CAST((SELECT count(*) FROM collections) + (SELECT count(*) FROM ingest_jobs) + (SELECT count(*) FROM doc_registry) AS BIGINT) AS total")
def _(s, d):
    return telemetry.totals(*(read_table(s, d, t) for t in ("collections", "ingest_jobs", "doc_registry")))


@query("text_digests", "SELECT doc_id, md5(text) AS short, sha256(text) AS long FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return read_table(s, d, "documents").filter("text is not null").select("doc_id", C.digest(F.col("text"), 128).alias("short"), C.digest(F.col("text")).alias("long"))


@query("languages_guessed")
def _(s, d):
    g = read_table(s, d, "documents").select("doc_id", C.detect_language(F.col("text")).alias("g"))
    return g.select("doc_id", "g.language", F.round("g.confidence", 4).alias("confidence"), C.language_family(F.col("g.language")).alias("family"))


@query("bm25_multilingual")
def _(s, d):
    lang = F.coalesce(F.nullif(F.regexp_extract(F.lower("lang"), r"^\s*([a-z]+)", 1), F.lit("")), F.lit("en"))
    docs = read_table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", lang.alias("lang"))
    items = read_table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), "text", "lang")
    return rounded(retrieval.multilingual_bm25(docs, items, 5), "score", places=3).drop("rank")


SQL["bm25_multilingual"] = r"""WITH l AS (SELECT doc_id, coalesce(nullif(regexp_extract(lower(lang), '^\s*([a-z]+)', 1), ''), 'en') AS lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
    t AS (SELECT doc_id, CASE WHEN lang IN ('zh', 'ja', 'th', 'lo', 'my', 'km') THEN flatten(list_transform(w, lambda x: CASE WHEN length(x) < 2 THEN [x] ELSE list_transform(range(1, length(x)), lambda i: substring(x, i, 2)) END)) ELSE w END AS w FROM l),
    tc AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t), df AS (SELECT term, count(*) AS df FROM tc GROUP BY 1),
    i0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS i FROM df, n), i AS (SELECT term, CASE WHEN i < 0 THEN 0.25 * (SELECT avg(i) FROM i0) ELSE i END AS idf FROM i0),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM eval_items) GROUP BY ALL),
    sc AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM q JOIN i USING (term) JOIN tc USING (term), n GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc) SELECT query_id, chunk_id, round(score, 3) AS score FROM r WHERE rank <= 5 AND score > 0"""


@query("sources_shown", f"WITH {CHUNK}, r AS (SELECT filename AS query_id, chunk_id, content, row_number() OVER (PARTITION BY filename ORDER BY chunk_index, chunk_id) AS rank FROM c) SELECT query_id, chunk_id, rank, CASE WHEN length(content) > 500 THEN content[1:500] || '…' ELSE content END AS snippet FROM r WHERE rank <= 5")
def _(s, d):
    c = distinct_chunks(s, d).select(F.col("filename").alias("query_id"), "chunk_id", "filename", (-F.col("chunk_index")).cast("double").alias("score"), F.col("content").alias("text"))
    return context.sources(ranked.ranked(c), 5).select("query_id", "chunk_id", "rank", "snippet")


@query("vector_hits_joined", f"WITH {V} SELECT a.query_id, a.chunk_id, v.label, round(a.score, 4) AS score FROM a JOIN v ON v.vec_id = a.chunk_id WHERE rank <= 10")
def _(s, d):
    return rounded(vector_run(s, d, 10).join(vectors(s, d).select("chunk_id", "label"), "chunk_id"), "score").drop("rank")


SQL["pinned_injection"] = f"""WITH {CHUNK}, f AS (SELECT collection_id, min(filename) AS filename FROM c WHERE chunk_index = 0 GROUP BY 1),
    p AS (SELECT c.*, sum(length(content)) OVER w AS run, row_number() OVER w AS place FROM c JOIN f USING (collection_id, filename) WINDOW w AS (PARTITION BY collection_id ORDER BY chunk_index, chunk_id ROWS UNBOUNDED PRECEDING)),
    o AS (SELECT collection_id, chunk_id, filename, CAST(length(content) AS DOUBLE) / 100000 AS score, row_number() OVER (PARTITION BY collection_id ORDER BY length(content) DESC NULLS LAST, chunk_id) AS rank FROM c),
    u AS (SELECT collection_id AS query_id, chunk_id, filename, CAST(1 AS DOUBLE) AS score, 0 AS own, place FROM p WHERE run <= 8000 UNION ALL SELECT o.collection_id, o.chunk_id, o.filename, o.score, 1, o.rank FROM o LEFT JOIN f ON f.collection_id = o.collection_id AND f.filename = o.filename WHERE o.rank <= 10 AND f.filename IS NULL)
    SELECT query_id, chunk_id, filename, round(CAST(score AS DOUBLE), 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY own, place, chunk_id) AS rank FROM u"""

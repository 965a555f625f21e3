"""Hand-made cases of operators that SQL can't say, and of odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvine.functions import columns as C
from corvine.operators import chunking, classify, context, encode, evaluation, filters, graph, ingest, multihop, names, ranked, retrieval, search, tables, telemetry, understanding, verify
from corvine.sources import sinks

RUN = "query_id string, chunk_id string, score double, rank int"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


# Search.


def brute(vectors, queries, k, metric):
    out = {}
    for q, e in queries:
        s = []
        for c, v in vectors:
            if v is None or len(v) != len(queries[0][1]):
                continue
            a, b = np.array(e), np.array(v)
            n = np.linalg.norm(a) * np.linalg.norm(b)
            if metric == "cosine" and n == 0:
                continue
            s.append((-(a @ b / n if metric == "cosine" else 1 / (1 + np.linalg.norm(a - b))), c))
        out[q] = [c for _, c in sorted((round(x, 9), c) for x, c in s)[:k]]
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("block", [48 << 20, 400])
def test_vector_search(spark, monkeypatch, metric, block):
    monkeypatch.setattr(search, "BLOCK_BYTES", block)
    rng = np.random.default_rng(1)
    base = [(f"c{i:03}", rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(150)]  # many ties
    vectors = base + [("n", None), ("s", [1.0]), ("z", [0.0] * 4)]
    queries = [(f"q{i}", rng.integers(1, 3, 4).astype(float).tolist()) for i in range(9)]
    v = spark.createDataFrame(vectors, "chunk_id string, embedding array<double>").selectExpr("*", "1 AS score", "2 AS query_id")
    q = spark.createDataFrame(queries, "query_id string, embedding array<double>")
    got = {}
    for r in search.vector_top_k(v.repartition(5), q, 7, metric=metric).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == brute(vectors, queries, 7, metric)
    assert search.vector_top_k(v, q.limit(0), 3).count() == search.vector_top_k(v.limit(0), q, 3).count() == 0


@pytest.mark.parametrize("block", [48 << 20, 200])
def test_bm25(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK_BYTES", block)
    docs = [("a", "The cat sat"), ("b", "the dog"), ("c", "cat cat dog"), ("d", None), ("e", ""), ("f", "bird")]
    q = [("q1", "cat dog cat"), ("q2", "the unknown"), ("q3", None)]
    d, qs = spark.createDataFrame(docs, "chunk_id string, text string"), spark.createDataFrame(q, "query_id string, text string")
    toks = {c: (t or "").lower().split() for c, t in docs}
    n, mean = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {w: sum(w in t for t in toks.values()) for t in toks.values() for w in t}
    idf0 = {w: np.log(n - x + 0.5) - np.log(x + 0.5) for w, x in df.items()}
    idf = {w: x if x >= 0 else 0.25 * np.mean(list(idf0.values())) for w, x in idf0.items()}
    want = {}
    for i, t in q:
        for c, ws in toks.items():
            s = sum(idf[w] * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in (t or "").lower().split() if w in ws)
            if any(w in ws for w in (t or "").lower().split()):
                want[i, c] = round(s, 6)
    got = {(r.query_id, r.chunk_id): r.score for r in search.bm25(d, qs, 9).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    full = [(r.query_id, r.chunk_id, r.score) for r in search.bm25(d, qs, 4, keep_zero=True).orderBy("query_id", "rank").collect()]
    assert [len([x for x in full if x[0] == i]) for i in ("q1", "q2", "q3")] == [4, 4, 4] and [x[1] for x in full if x[0] == "q3"] == ["a", "b", "c", "d"]
    assert search.bm25(d.limit(0), qs, 3).count() == search.bm25(d, qs.limit(0), 3).count() == 0


def test_multilingual_bm25(spark):
    d = spark.createDataFrame([("a", "the cat", "en"), ("b", "缓存索引", "zh"), ("c", "the the", "en")], "chunk_id string, text string, lang string")
    q = spark.createDataFrame([("q", "索引", "zh"), ("r", "the cat", "en")], "query_id string, text string, lang string")
    got = {(r.query_id, r.chunk_id) for r in retrieval.multilingual_bm25(d, q, 3, {"en": ["the"]}).collect()}
    assert got == {("q", "b"), ("r", "a")}


def test_grouping_after_a_union(spark):
    a = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.8, 2), ("p", "a", 0.1, 1)], RUN)
    b = spark.createDataFrame([("q", "c", 0.85, 1), ("p", "a", 0.3, 1)], RUN)
    g = spark.createDataFrame([("q", "low"), ("p", "high")], "query_id string, level string")
    got = sorted((r.query_id, r.chunk_id, r.rank) for r in ranked.corrective_merge(ranked.ranked(a.drop("rank")), ranked.ranked(b.drop("rank")), g, 2).collect())
    assert got == [("p", "a", 1), ("q", "a", 1), ("q", "c", 2)]


# Lists.


def test_rerank(spark):
    run = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.8, 2), ("q", "c", 0.7, 3), ("p", "a", 0.5, 1)], RUN)
    q = spark.createDataFrame([("q", "red cat"), ("p", "blue")], "query_id string, text string")
    t = spark.createDataFrame([("a", "a cat"), ("b", "Red cat here"), ("c", None)], "chunk_id string, text string")
    out = retrieval.rerank(run, q, t, 5)
    assert [(r.query_id, r.chunk_id, r.score) for r in out.orderBy("query_id", "rank").collect()] == [("q", "b", 1.0), ("q", "a", 0.5)]
    assert {r.query_id: r.dropped for r in retrieval.dropped(run, out).collect()} == {"q": 1, "p": 1}
    s = spark.createDataFrame([("q", "c", 0.9)], "query_id string, chunk_id string, score double")
    assert [(r.query_id, r.chunk_id) for r in retrieval.rerank_by(run, s, 2).orderBy("query_id", "rank").collect()] == [("p", "a"), ("q", "c"), ("q", "a")]


def test_contrastive_terms(spark):
    p = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.8, 2), ("q", "c", 0.25, 3)], RUN)
    n = spark.createDataFrame([("q", "x", 0.9, 1)], RUN)
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("x", [1.0, 0.1]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    t = spark.createDataFrame([("a", "x"), ("b", "Old stock, old"), ("c", "old old old old")], "chunk_id string, text string")
    terms = spark.createDataFrame([("q", ["old"])], "query_id string, terms array<string>")
    got = {r.chunk_id: round(r.score, 3) for r in ranked.contrastive(p, n, v, 5, texts=t, terms=terms).collect()}
    assert got == {"a": 0.402, "b": 0.6}  # c falls below 0


def test_near_duplicates_fall_back_on_words(spark):
    rows = [("q", "a", 0.9, 1, [1.0, 0.0], "x"), ("q", "b", 0.8, 2, [1.0, 0.01], "y"), ("q", "c", 0.7, 3, None, "red cat sat"), ("q", "d", 0.6, 4, None, "Red cat sat"), ("q", "e", 0.5, 5, None, None), ("q", "f", 0.4, 6, [0.0, 1.0], None)]
    df = spark.createDataFrame(rows, f"{RUN}, embedding array<double>, text string")
    assert [r.chunk_id for r in context.remove_near_duplicates(df).orderBy("rank").collect()] == ["a", "c", "e", "f"]
    assert [r.chunk_id for r in context.diversify(df, 9).orderBy("rank").collect()][0] == "a"


def test_semantic_cache_rules(spark):
    e = "embedding array<double>, k int, filter string"
    q = spark.createDataFrame([("same", [1.0, 0.0], 5, None), ("k", [1.0, 0.0], 6, None), ("f", [1.0, 0.0], 5, "x"), ("far", [0.0, 1.0], 5, None)], f"query_id string, {e}")
    c = spark.createDataFrame([(1, [1.0, 0.0], 5, None, "2030-01-01 00:00:00"), (2, [1.0, 0.01], 5, None, "2030-01-01 00:59:00"), (3, [1.0, 0.0], 7, "x", "2030-01-01 00:59:30")], f"cache_id int, {e}, ts string").withColumn("ts", F.to_timestamp("ts"))
    now = "2030-01-01 01:10:00"
    assert {(r.query_id, r.cache_id) for r in telemetry.semantic_cache(q, c, now).collect()} == {("same", 2)}
    assert {(r.query_id, r.cache_id) for r in telemetry.semantic_cache(q, c, now, ttl_seconds=0).collect()} == {("same", 1)}
    assert telemetry.semantic_cache(q, c, now, ttl_seconds=0, most=1).count() == 0
    x = spark.createDataFrame([("a",), ("b",)], "cache_key string")
    y = spark.createDataFrame([("a", "2030-01-01 00:30:00"), ("b", "2030-01-01 00:00:00")], "cache_key string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.cache_key for r in telemetry.exact_cache(x, y, now).collect()] == ["a"]


# Queries.


def test_negation(spark):
    n = lambda q: one(spark, understanding.negation(F.col("q")), q=q)
    x = n("cats but not dogs other than big ones")
    assert x.kind == "exclusion" and x.terms == ["dogs", "other", "than", "dogs other than big ones"] and x.confidence == 0.9 and x.positive_query == "cats but dogs big ones"
    assert n("plain words").kind == "none" and n("plain words").positive_query == "plain words" and n("plain words").negative_query is None
    y = n("cats versus dogs")
    assert (y.kind, y.terms, y.confidence, y.positive_query, y.negative_query) == ("contrast", ["dogs"], 0.75, "cats dogs", "dogs")


def test_classifier(spark):
    c = lambda q: tuple(one(spark, classify.classify(F.col("q")), q=q))
    assert c("Who is she?") == ("factoid", 1.0) and c("cats") == ("factoid", 0.5) and c("compare a versus b") == ("comparative", 0.75)
    assert c("REQ-12 is it")[0] == "exact_match" and c("anything described")[0] == "factoid"  # small letters are no serial number
    assert one(spark, classify.classify(F.col("q"), F.lit("de")), q="wie kann man das machen").kind == "procedural"


def test_hops(spark):
    p = lambda q: one(spark, multihop.decompose(F.col("q")), q=q)
    assert [(h.hop_id, h.query, h.parents) for h in p("based on X and then Y's Z").hops] == [(0, "based on X", []), (1, "Y's Z", [0])]
    assert [h.query for h in p("Compare cats and dogs").hops] == ["Compare Compare cats", "Compare dogs", "Compare cats and dogs"] and p("plain").confidence == 0.5
    plan = spark.createDataFrame([("q", 0, "who founded it", []), ("q", 1, "what did [Ann] start", [0]), ("p", 0, "only this", [])], "query_id string, hop_id int, query string, parents array<int>")
    asked = []

    def find(queries, k):
        asked.extend((r.query_id, r.text) for r in queries.collect())
        return queries.select("query_id", F.when(F.contains("text", F.lit("Smith")), "c2").otherwise("c1").alias("chunk_id"), F.length("text").cast("double").alias("score"), F.lit(1).alias("rank"))

    people = spark.createDataFrame([("c1", "Ann Smith"), ("c1", "Bo")], "chunk_id string, name string")
    got = {(r.query_id, r.chunk_id) for r in multihop.execute(plan, find, 3, people).collect()}
    assert ("q", "what did Ann Smith start") in asked and got == {("q", "c1"), ("q", "c2"), ("p", "c1")}


def test_verdicts(spark):
    v = lambda a, s, k="factoid", sem=None: one(spark, verify.verify(F.lit(k), F.col("a"), F.col("s"), F.lit(sem) if sem is not None else None), a=a, s=s)
    good = v("cats chase small mice daily", "the cats chase small mice daily", sem=1.0)
    assert good.status == "verified" and good.present and not good.issues
    assert v("it was 12 of 99 in total there", "other words", sem=1.0).status == "hallucination" and not v("a", None).present
    assert v("I don't know about any of that", "x").completeness == 0.3 and v("cats chase small mice daily", "x", "multi_hop").completeness == 0.7


def test_grade_of_nothing(spark):
    run = spark.createDataFrame([], RUN)
    q = spark.createDataFrame([("q", "factoid", False)], "query_id string, kind string, requires_exact boolean")
    r = understanding.grade(run, queries=q).first()
    assert (r.confidence, r.level, r.issues, r.fallbacks) == (0.0, "very_low", ["no_results"], ["expand_search", "relax_filters", "multi_query"])


def test_implied_filters(spark):
    f = lambda q: one(spark, filters.implied(F.col("q")), q=q)
    x = f("2021 agreement in quarter 4 from the Legal section")
    assert (x.date_year, x.quarter, x.doc_type, x.section, x.is_table) == (2021, 4, "contract", "Legal", False)
    assert f("in file 'a b.pdf' table").filename.strip() == "a b.pdf" and f("tables").is_table is False
    rows = spark.createDataFrame([(1, 2021, "contract"), (2, 2020, "contract"), (3, 2021, None)], "id int, date_year int, doc_type string")
    q = spark.createDataFrame([("a", "2021 terms"), ("b", "any")], "query_id string, text string")
    assert {(r.query_id, r.id) for r in filters.matching(q, rows).collect()} == {("a", 1), ("b", 1), ("b", 2), ("b", 3)}


def test_filters_reach_the_scan(spark, tiny):
    d = spark.read.parquet(f"{tiny}/documents.parquet")
    plan = d.filter(filters.predicate({"n_chars": {"$gte": 500}, "source": "archive", "doc_type": {"$in": ["pdf"]}}, F.col, dict(d.dtypes))).select("doc_id")._jdf.queryExecution().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(n_chars,500)" in pushed and "IsNotNull(source)" in pushed
    assert d.filter(filters.where([("n_chars", "range", (1, 10)), ("doc_type", "odd", 1)], F.col, dict(d.dtypes))).count() == d.filter("n_chars between 1 and 10").count()
    m = spark.createDataFrame([('{"a": 3, "filename": "X.pdf"}',), ("{}",)], "metadata string")
    assert m.filter(filters.to_sql({"a": {"$gt": 2}, "filename": "x."})).count() == 1 and m.filter(filters.to_sql({"a": {"$odd": 1}})).count() == 0


def test_hypothetical(spark):
    docs = spark.createDataFrame([("q", 0, [1.0, 0.0]), ("q", 1, [0.0, 1.0])], "query_id string, doc_no int, embedding array<double>")
    corpus = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [1.0, 0.0]), ("c", [-1.0, 0.1])], "chunk_id string, embedding array<double>")
    first = lambda how: retrieval.hypothetical(docs, corpus, 2, how).orderBy("rank").first().chunk_id
    assert first("average") == "a" and first("max") == "b" and first("rrf") in ("a", "b")
    assert one(spark, retrieval.hypothetical_prompt(F.col("q"), F.lit("xx")), q="why") == retrieval.PROMPTS["en"] + "why"


# Chunks, tables, names, graph.


def test_headings_stay_with_chunks(spark):
    df = spark.createDataFrame([("a.md", "# A\n\nx\n\n## B\n\ny")], "filename string, text string")
    rows = chunking.chunk_documents(df, 50, 10, 1).orderBy("chunk_index").collect()
    assert [r.headings for r in rows] == [{"Header 1": "A"}, {"Header 1": "A", "Header 2": "B"}]
    x = chunking.chunk_documents(df, 50, 10, 1).orderBy("chunk_index").select(chunking.contextual(F.lit("T"), F.lit(None).cast("string"), F.col("content"), F.lit("sum."), F.col("headings")).alias("c")).collect()
    assert x[1].c == "Document: T. Context: sum. Section: A > B.\n\ny"


def test_parents_overlap(spark):
    df = spark.createDataFrame([("f", i, 40) for i in range(6)], "filename string, chunk_index int, n_tokens int")
    got = [tuple(r)[1:] for r in chunking.parents(df, 120, 50).orderBy("parent_no").collect()]
    assert got == [(0, 0, 2, 120), (1, 2, 4, 120), (2, 4, 5, 80)]
    assert {r.chunk_index: r.parent_no for r in chunking.children(chunking.parents(df, 120, 50)).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2}


def test_tables(spark):
    pipe = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'x' * 30} |" for i in range(40))
    html = "<table><thead><tr><th>H</th></tr></thead>\n<tr><td>1</td></tr>\n</table>"
    aligned = "\n".join(f"name{i}     value number {i}   more" for i in range(4))
    text = f"Intro text here.\n\n{pipe}\n\nMiddle text.\n\n{html}\n\n{aligned}\n\nEnd."
    found = tables.regions(text)
    assert [r[2] for r in found] == ["markdown", "html", "plain_text"] and found[0][4] == ["a", "b"] and found[1][4] == ["H"] and text[found[0][0] : found[0][1]] == pipe
    parts = tables.split_rows(pipe, "markdown", 100)
    assert len(parts) > 3 and all(p.startswith("| a | b |\n|---|---|\n") and chunking.tokens(p) <= 100 for p in parts) and sum(p.count("\n") - 1 for p in parts) == 40
    df = spark.createDataFrame([("f", text), ("n", None), ("e", " ")], "filename string, text string")
    rows = tables.chunk_with_tables(df, 50, 10, 1, 100).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and [r.kind for r in rows if r.is_table][-1] == "plain_text" and tables.detect(df).count() == 3


def test_names(spark):
    c = spark.createDataFrame([("1", "Python and python use HTTP at /api/v1/x; no merger."), ("2", None)], "chunk_id string, text string")
    got = {(r.name, r.kind): r.mentions for r in names.domain_names(c, "technical", [(r"\bmerger\b", "OWN", 9)], {"OWN": ["use"]}).collect()}
    assert got[("Python", "PROGRAMMING_LANGUAGE")] == ["Python", "python"] and ("merger", "OWN") in got and ("use", "OWN") in got and ("/api/v1/x", "API_ENDPOINT") in got
    g = spark.createDataFrame([("1", "PYTHON", "X"), ("1", "Ann Lee", "P")], "chunk_id string, name string, kind string")
    d = names.domain_names(c, "technical").select("chunk_id", "name", "kind")
    assert ("PYTHON", "X") in {(r.name, r.kind) for r in names.merge_names(g, d).collect()} and ("Python", "PROGRAMMING_LANGUAGE") in {(r.name, r.kind) for r in names.merge_names(g, d, "domain_first").collect()}
    assert names.domain_names(c, "none").count() == 0


def test_typed_entities(spark):
    c = spark.createDataFrame([("1", "Big Start here. We met Ann Lee in New York", "Title One", None), ("2", None, None, " ")], "chunk_id string, text string, title string, section string")
    assert {(r.name, r.kind) for r in graph.typed_entities(c).collect()} == {("Title One", "CONCEPT"), ("Ann Lee", "ENTITY"), ("New York", "ENTITY")}


def test_graph_views(spark, tmp_path):
    m = spark.createDataFrame([("1", "A"), ("1", "B"), ("2", "A"), ("2", "B"), ("3", "C"), ("3", "B")], "chunk_id string, name string")
    e = graph.co_occurrence(m)
    t = graph.trace(spark.createDataFrame([("q", "B", 0), ("q", "A", 1), ("q", "C", 1)], "query_id string, name string, hops int"), e, 2, 1).first()
    assert [x.name for x in t.names] == ["B", "A"] and [(x.src, x.dst, x.weight) for x in t.edges] == [("A", "B", 2)] and (t.total_names, t.total_edges) == (3, 1)
    p = graph.page_rank(e, 5)
    graph.save(f"file://{tmp_path}/g", m, e, p)
    assert [x.count() for x in graph.load(spark, f"file://{tmp_path}/g")] == [6, 4, 3]
    v, x = graph.export(m, e, p, 1)
    assert v.count() == 4 and x.filter("kind = 'mentions'").count() == 2
    vec = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [float("nan"), 0.0]), ("3", [0.0, 0.0])], "chunk_id string, embedding array<double>")
    assert {r.name: r.embedding for r in graph.centroids(m, vec).collect()} == {"A": [1.0, 0.0], "B": [1.0, 0.0]}
    run = spark.createDataFrame([("q", "1", 0.5, 1), ("q", "3", 0.4, 2), ("p", "2", 0.3, 1)], RUN)
    qv = spark.createDataFrame([("q", [1.0, 0.0]), ("p", [1.0, 0.0])], "query_id string, embedding array<double>")
    ex = spark.createDataFrame([("q", "A", 0.5)], "query_id string, name string, importance double")
    got = {(r.query_id, r.chunk_id): round(r.score, 3) for r in graph.rescore_by_vectors(run, qv, vec.filter("chunk_id <> '2'"), graph.centroids(m, vec), m, ex).collect()}
    assert got == {("q", "1"): 0.85, ("p", "2"): 0.3}


def test_trace_has_all_names_and_edges(spark):
    names = [f"N{k:02}" for k in range(45)]
    e = graph.co_occurrence(spark.createDataFrame([("1", x) for x in names] + [("2", x) for x in names[-2:]], "chunk_id string, name string"))
    t = graph.trace(spark.createDataFrame([("q", x, 1) for x in names] + [("p", "N00", 0)], "query_id string, name string, hops int"), e)
    got = {r.query_id: r for r in t.collect()}
    assert [x.name for x in got["q"].names] == names and (got["q"].total_names, got["q"].total_edges) == (45, 990)
    assert [(x.src, x.dst, x.weight) for x in got["q"].edges[:2]] == [("N43", "N44", 2), ("N00", "N01", 1)] and len(got["q"].edges) == 990
    assert got["p"].edges is None and (got["p"].total_names, got["p"].total_edges) == (1, 0)


def test_graph_trace_counts_all_edges_between_neighbours(spark, tmp_path):
    from corvine.plans import catalog, more  # noqa: F401

    words = [f"Name {a}{b}" for a in ("Al", "Be", "Ce") for b in "abc"]
    rows = [("f-0", "c", "f", 0, ", ".join(words)), ("f-1", "c", "f", 1, f"{words[0]}, Far Off")]
    spark.createDataFrame(rows, "chunk_id string, collection_id string, filename string, chunk_index int, content string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r.query_id: (r.total_names, r.total_edges) for r in catalog.QUERIES["graph_trace"](spark, str(tmp_path)).collect()}
    assert got == {words[0]: (10, 37), "Far Off": (2, 1)} | {w: (9, 36) for w in words[1:]}


def test_graph_trace_shuffles_neither_texts_nor_products(spark, tmp_path):
    """What a name of all queries leads to isn't multiplied by the queries, and texts stay where they are read."""
    import random

    from corvine.plans import catalog, more  # noqa: F401

    rng, n = random.Random(1), 400
    letters = "abcdefghijklmnopqrstuvwxyz"
    leaf = [f"Leaf {letters[k // 26].upper()}{letters[k % 26]}x" for k in range(n)]
    rows = [(f"f-{k}", "c", "f", k, f"Big Hub, {leaf[k]}; " + "".join(rng.choices(letters, k=2000))) for k in range(n)]
    spark.createDataFrame(rows, "chunk_id string, collection_id string, filename string, chunk_index int, content string").write.parquet(f"{tmp_path}/chunks.parquet")

    def written() -> tuple[int, int]:
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        each = [stages.apply(i) for i in range(stages.size())]
        return sum(x.shuffleWriteRecords() for x in each), sum(x.shuffleWriteBytes() for x in each)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        got = {r.query_id: (r.total_names, r.total_edges) for r in catalog.QUERIES["graph_trace"](spark, str(tmp_path)).collect()}
        rows_out, bytes_out = (b - a for a, b in zip(before, written()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {"Big Hub": (n + 1, n)} | {x: (2, 1) for x in leaf}
    assert rows_out < 30 * n and bytes_out < 1000 * n


# Ingest, encoders, sinks, evaluation.


def test_ingest_plan(spark):
    old = spark.createDataFrame([("f", "x")], "file string, content string").select("file", F.sha2("content", 256).alias("hash"))
    new = lambda *xs: spark.createDataFrame([("f", i, x) for i, x in enumerate(xs)], "file string, chunk_index int, content string")
    a, b = ({r.hash: (r.chunk_id, r.action) for r in ingest.ingest_plan(old, n, ["file"]).collect() if r.action != "remove"} for n in (new("x", "y"), new("new", "x", "y")))
    assert sorted(v[1] for v in a.values()) == ["embed", "keep"] and all(b[h][0] == a[h][0] for h in a)  # ids don't move
    assert [r.action for r in ingest.ingest_plan(old, new("z"), ["file"]).orderBy("action").collect()] == ["embed", "remove"]
    jobs = spark.createDataFrame([("a", "queued", 0.0, None), ("b", "completed", 1.0, None)], "job_id string, status string, progress double, error string")
    ev = spark.createDataFrame([("a", "parsed", None, 1), ("a", "stored", None, 2), ("b", "parsed", "late", 3), ("c", "chunked", "bad", 1)], "job_id string, stage string, error string, at int")
    assert {r.job_id: (r.status, r.progress) for r in ingest.advance(jobs, ev).collect()} == {"a": ("completed", 1.0), "b": ("completed", 1.0), "c": ("failed", 0.4)}


def test_encoders(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None), (4, "c")], "id int, text string")
    v = {r.id: r.embedding for r in encode.encode(df, "id", "text", encode.hashing_encoder, "e5").collect()}
    assert v[3] is None and v[2] == v[4] and np.linalg.norm(v[1]) == pytest.approx(1)
    cache = encode.encode(df.filter("id = 1"), "id", "text", encode.hashing_encoder).select(encode.cache_key(F.lit("a b"), "m").alias("cache_key"), "embedding")
    every, fresh = encode.encode_missing(df, "id", "text", cache, encode.hashing_encoder, "m")
    assert fresh.count() == 1 and every.filter("embedding is not null").count() == 3
    s = df.select(encode.structure(F.lit("# H\n- a\n```x```"), F.lit("t"), F.lit(None).cast("string"), F.lit(5)).alias("f")).first().f
    assert s[0] == 0.2 and s[1] == 0.1 and s[2] == 1.0 and s[5] == 1.0 and s[6] == 0.0 and s[7] == 0.05
    e = df.select(encode.with_structure(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0)), 0.5).alias("e")).first().e
    assert e == pytest.approx([2**-0.5, 2**-0.5])
    x = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.1 * (i % 2)]) for i in range(20)], "id int, v array<double>")
    p = np.array([r.point for r in encode.project(x, "id", "v").orderBy("id").collect()])
    assert abs(np.corrcoef(p[:, 0], np.arange(20))[0, 1]) > 0.999 and encode.project(x.limit(0), "id", "v").count() == 0
    assert tuple(encode.too_long(df, "text", 0).first()) == (0, 0)


def test_sinks_and_checks(spark, tmp_path):
    df = spark.createDataFrame([("q", ["a"])], "query_id string, xs array<string>")
    for _ in range(2):
        sinks.append_log(df, f"file://{tmp_path}/log")
        sinks.append_events(df, f"file://{tmp_path}/events")
    assert spark.read.json(f"file://{tmp_path}/log").count() == 2 and spark.read.parquet(f"file://{tmp_path}/events").first().xs == '["a"]'
    evaluation.export(spark.createDataFrame([(0.5, 1)], "mrr double, n int"), f"file://{tmp_path}/m", "csv")
    assert {r.metric: r.value for r in spark.read.option("header", True).csv(f"file://{tmp_path}/m").collect()} == {"mrr": "0.5", "n": "1"}
    q = spark.createDataFrame([("x", 5, "c"), (" ", 5, "c"), ("x", 51, "c"), ("x", 5, "c d"), ("x" * 10_001, 5, "c")], "text string, k int, collection_id string")
    assert [r.error for r in sinks.check_queries(q).collect()] == [None, "empty query", "k out of range", "bad collection id", "query too long"]
    assert sinks.safe_name("../a/b<c>.pdf") == "b_c_.pdf" and len(sinks.safe_name("x" * 300 + ".md")) == 255
    for bad in (lambda: sinks.check_chunking(5, 0), lambda: sinks.check_chunking(100, 100), lambda: sinks.safe_name("a/..")):
        with pytest.raises(ValueError):
            bad()


def test_judges(spark):
    s = spark.createDataFrame([("q", "a", "c", 1.7), ("q", "b", "c", None)], "query string, answer string, context string, s double")
    got = [r.j for r in evaluation.judge(s, {"j": lambda q, a, c: F.when(a == "a", 1.7)}).collect()]
    assert got == [1.0, 0.5]
    c = spark.createDataFrame([("c1", "x")], "chunk_id string, text string")
    assert evaluation.questions(c, lambda t: F.array(F.concat(F.lit("What is "), t, F.lit("?")), F.lit(""))).first().query == "What is x?"


def test_columns(spark):
    x = lambda c, **v: one(spark, c, **v)
    assert x(C.char_bigrams(F.col("a")), a="abc") == ["ab", "bc"] and x(C.char_bigrams(F.col("a")), a="a") == ["a"]
    assert x(C.occurrences(F.col("a"), F.lit("aa")), a="aaaa") == 2 and x(C.file_name(F.col("a")), a="/x/y.pdf") == "y.pdf"
    assert x(C.detect_language(F.col("a")), a="the cat and the dog").language == "en" and x(C.detect_language(F.col("a")), a="缓存返回").language == "zh" and x(C.detect_language(F.col("a")), a=" ").confidence == 0.0
    assert x(C.language_family(F.col("a")), a="de") == "germanic" and x(C.is_cjk(F.col("a")), a="ja") and not x(C.is_unspaced(F.col("a")), a="en")
    C.register(spark)
    assert spark.sql("SELECT token_count('12345678') AS n, dot_product(array(1D, 2D), array(3D, 4D)) AS d").first() == (2, 11.0)
    assert x(understanding.variations(F.col("a")), a="cats") == ["cats", "What is cats?", "How does cats work?"]

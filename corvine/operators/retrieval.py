"""Retrieval put together: hybrid lists, reranking, hypothetical documents,
BM25 by language. Models come in as callables or as tables of scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.functions.columns import language_tokens, whitespace_tokens
from corvine.operators import ranked
from corvine.operators.search import bm25, vector_top_k


def hybrid(vectors: DataFrame, texts: DataFrame, queries: DataFrame, k: int, how: str = "rrf", alpha: Column | float = 0.7, tokens: Callable = whitespace_tokens) -> DataFrame:
    """The k best of ``2 k`` by vector and ``2 k`` by words, fused by reciprocal
    rank (``how='rrf'``) or by scores (``minmax``, ``zscore``) weighted ``alpha``.

    Takes ``vectors(chunk_id, embedding)``, ``texts(chunk_id, text)`` and
    ``queries(query_id, embedding, text)``; ``alpha`` may be a column of
    ``(query_id)``-wise weights named ``alpha`` in ``queries``.
    """
    v = vector_top_k(vectors, queries.select("query_id", "embedding"), 2 * k)
    w = bm25(texts, queries.select("query_id", "text"), 2 * k, tokens=tokens)
    if how == "rrf":
        return ranked.reciprocal_rank_fusion([v, w]).filter(F.col("rank") <= k)
    normalise = {"minmax": ranked.min_max, "zscore": ranked.z_score}[how]
    if isinstance(alpha, Column):
        own = queries.select("query_id", alpha.alias("alpha"))
        a = normalise(v).select("query_id", "chunk_id", F.col("score").alias("v"))
        b = normalise(w).select("query_id", "chunk_id", F.col("score").alias("l"))
        both = a.join(b, ["query_id", "chunk_id"], "full_outer").join(own, "query_id")
        fused = both.select("query_id", "chunk_id", (F.col("alpha") * F.coalesce("v", F.lit(0.0)) + (1 - F.col("alpha")) * F.coalesce("l", F.lit(0.0))).alias("score"))
        return ranked.top_k(fused, k)
    return ranked.weighted_fusion(v, w, alpha, normalise).filter(F.col("rank") <= k)


def lexical_score(query: Column, text: Column) -> Column:
    """Share of a query's distinct tokens that a text holds: what stands in for a
    model that scores pairs."""
    q = F.array_distinct(whitespace_tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, whitespace_tokens(text))) / F.size(q)).otherwise(0.0)


def rerank(run: DataFrame, queries: DataFrame, texts: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = lexical_score, floor: float = 0.3) -> DataFrame:
    """A run in the order of ``scorer(query, text)``, without rows below ``floor``
    (0 or less keeps all), cut to k. ``scorer`` makes a column: built-in
    functions, or a Pandas UDF around a model. A list may become empty; rows
    without a text score 0. Ties go by chunk."""
    x = run.select("query_id", "chunk_id").join(queries.select("query_id", F.col("text").alias("_q")), "query_id").join(texts.select("chunk_id", F.col("text").alias("_t")), "chunk_id", "left")
    scored = x.select("query_id", "chunk_id", F.coalesce(scorer(F.col("_q"), F.col("_t")), F.lit(0.0)).alias("score"))
    return ranked.top_k(ranked.floor_by(scored, floor), k)


def dropped(run: DataFrame, kept: DataFrame) -> DataFrame:
    """``(query_id, dropped)``: how many rows of each list a floor has taken."""
    a = run.groupBy("query_id").agg(F.count("*").alias("n"))
    b = kept.groupBy("query_id").agg(F.count("*").alias("m"))
    return a.join(b, "query_id", "left").select("query_id", (F.col("n") - F.coalesce("m", F.lit(0))).alias("dropped"))


def rerank_by(run: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """A run in the order of ``scores(query_id, chunk_id, score)``, as a language
    model gives them: what it leaves out scores 0, and a query it says nothing of
    keeps its order. Equal scores keep the run's order."""
    s = scores.groupBy("query_id", "chunk_id").agg(F.max("score").alias("new"))
    told = s.select("query_id").distinct().withColumn("told", F.lit(1))
    x = run.join(told, "query_id", "left").join(s, ["query_id", "chunk_id"], "left")
    x = x.withColumn("score", F.when(F.col("told") == 1, F.coalesce("new", F.lit(0.0))).otherwise(F.col("score")))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.when(F.col("told") == 1, F.col("score")).otherwise(F.lit(0.0)).desc(), F.col("rank")))
    return x.select("query_id", "chunk_id", "score", place.alias("rank")).filter(F.col("rank") <= k)


def mean_vectors(documents: DataFrame) -> DataFrame:
    """``(query_id, embedding)``: the mean, of length 1, of each query's
    ``(query_id, embedding)`` rows, summed per dimension before it is shuffled."""
    e = documents.filter("embedding is not null").select("query_id", F.posexplode("embedding").alias("i", "x")).groupBy("query_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = e.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    return v.select("query_id", F.transform("e", lambda x: x / F.when(norm > 0, norm).otherwise(1.0)).alias("embedding"))


def hypothetical(documents: DataFrame, corpus: DataFrame, k: int, how: str = "average") -> DataFrame:
    """Search by hypothetical documents ``(query_id, doc_no, embedding)``: by their
    mean vector (``average``), or by each, keeping the best score (``max``) or
    fusing the ranks (``rrf``)."""
    if how == "average":
        return vector_top_k(corpus, mean_vectors(documents), k)
    kind = dict(documents.dtypes)["query_id"]
    each = documents.select(F.to_json(F.struct(F.col("query_id").alias("q"), F.col("doc_no").alias("d"))).alias("query_id"), "embedding")
    lists = vector_top_k(corpus, each, 2 * k).withColumn("query_id", F.get_json_object("query_id", "$.q").cast(kind))
    score = F.max("score") if how == "max" else F.sum(1.0 / (ranked.RRF_K + F.col("rank")))
    return ranked.top_k(lists.groupBy("query_id", "chunk_id").agg(score.alias("score")), k)


def hypothetical_and_direct(documents: DataFrame, queries: DataFrame, corpus: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """``weight`` of the score by hypothetical documents and the rest of the
    query's own, either 0 where a chunk is missing from a list of ``2 k``."""
    same = lambda df: df
    return ranked.weighted_fusion(hypothetical(documents, corpus, 2 * k), vector_top_k(corpus, queries.select("query_id", "embedding"), 2 * k), weight, same).filter(F.col("rank") <= k)


#: Words that ask, and the lengths that part simple, medium and complex queries.
ASKING, SIMPLE, COMPLEX = ["what", "why", "how", "when", "where", "who", "which"], 5, 15


def hypothetical_count(q: Column, n: int = 3) -> Column:
    """How many hypothetical documents a query takes: none for a short one, one
    for a question of medium length, else ``n``."""
    words = whitespace_tokens(q)
    asks = F.arrays_overlap(words, F.array(*map(F.lit, ASKING)))
    return F.when(F.size(words) < SIMPLE, 0).when((F.size(words) < COMPLEX) & asks, 1).otherwise(n)


#: The task given to a model that writes a hypothetical document, by language.
PROMPTS = {
    "en": "Write a passage that answers the question: ",
    "fr": "Écris un passage qui répond à la question : ",
    "de": "Schreibe einen Abschnitt, der die Frage beantwortet: ",
    "es": "Escribe un pasaje que responda a la pregunta: ",
    "pt": "Escreva um trecho que responda à pergunta: ",
    "it": "Scrivi un brano che risponda alla domanda: ",
    "ru": "Напиши отрывок, который отвечает на вопрос: ",
    "zh": "请写一段文字回答这个问题：",
    "ja": "次の質問に答える文章を書いてください：",
    "ko": "다음 질문에 답하는 글을 쓰세요: ",
    "hi": "प्रश्न का उत्तर देने वाला अनुच्छेद लिखें: ",
    "th": "เขียนข้อความที่ตอบคำถาม: ",
}


def hypothetical_prompt(q: Column, language: Column) -> Column:
    """The task for a query in its language, English for others."""
    table = F.create_map(*[F.lit(x) for pair in PROMPTS.items() for x in pair])
    return F.concat(F.coalesce(F.try_element_at(table, F.coalesce(language, F.lit("en"))), F.lit(PROMPTS["en"])), q)


def multilingual_bm25(corpus: DataFrame, queries: DataFrame, k: int, stop: dict[str, list[str]] | None = None) -> DataFrame:
    """BM25 over ``corpus(chunk_id, text, lang)`` for ``queries(query_id, text,
    lang)`` with the tokens of each language; scores of 0 or less are dropped."""
    plain = lambda df, key: df.select(key, F.array_join(language_tokens(F.col("text"), F.col("lang"), stop), " ").alias("text"))
    return ranked.ranked(bm25(plain(corpus, "chunk_id"), plain(queries, "query_id"), k).drop("rank").filter("score > 0"))

"""Score algebra against cases worked out by hand."""

import math

import pytest

from corvine.operators import context, evaluation, ranked, search, understanding


def run(spark, rows):
    return ranked.ranked(spark.createDataFrame(rows, "query_id int, chunk_id string, score double"))


def scores(df):
    return {(r.query_id, r.chunk_id): r.score for r in df.collect()}


def test_min_max(spark):
    df = run(spark, [(1, "a", 10.0), (1, "b", 20.0), (1, "c", 30.0), (2, "a", 10.0), (3, "a", 10.0), (3, "b", 10.0)])
    s = scores(ranked.min_max(df))
    assert [s[1, x] for x in "abc"] == [0, 0.5, 1] and s[2, "a"] == s[3, "a"] == s[3, "b"] == 1


def test_z_score(spark):
    s = scores(ranked.z_score(run(spark, [(1, "a", 0.9), (1, "b", 0.5), (1, "c", 0.5), (1, "d", 0.1), (2, "a", 3.0)])))
    assert s[1, "b"] == s[1, "c"] == pytest.approx(0.5) and 0 < s[1, "d"] < 0.5 < s[1, "a"] < 1 and s[2, "a"] == 1


def test_rrf(spark):
    a = run(spark, [(1, "A", 3.0), (1, "B", 2.0), (1, "C", 1.0)])
    b = run(spark, [(1, "B", 3.0), (1, "D", 2.0), (1, "A", 1.0)])
    out = ranked.reciprocal_rank_fusion([a, b])
    s = scores(out)
    assert s[1, "B"] == pytest.approx(1 / 62 + 1 / 61) and s[1, "A"] == pytest.approx(1 / 61 + 1 / 63)
    assert [r.chunk_id for r in out.orderBy("rank").collect()] == ["B", "A", "D", "C"]


def test_hybrid(spark):
    v, b = run(spark, [(1, "1", 0.8), (1, "2", 0.5)]), run(spark, [(1, "1", 10.0), (1, "3", 5.0)])
    assert scores(ranked.weighted_fusion(v, b, 0.5)) == {(1, "1"): 1.0, (1, "2"): 0.0, (1, "3"): 0.0}
    assert scores(ranked.weighted_fusion(run(spark, [(1, "x", 0.2)]), run(spark, []), 0.7)) == {(1, "x"): 0.7}


def test_floor(spark):
    df = run(spark, [(1, "a", 0.9), (1, "b", 0.31), (1, "c", 0.29), (1, "d", 0.05)])
    assert sorted(k[1] for k in scores(ranked.floor_by(df, 0.3))) == ["a", "b"] and ranked.floor_by(df, 0).count() == 4


def test_corrective(spark):
    first, again = run(spark, [(1, "a", 0.4), (2, "z", 0.9)]), run(spark, [(1, "b", 0.8), (1, "a", 0.2), (3, "x", 0.6)])
    g = spark.createDataFrame([(1, "low"), (2, "high"), (3, "very_low")], "query_id int, level string")
    assert scores(ranked.corrective_merge(first, again, g, 3)) == {(1, "b"): 0.8, (1, "a"): 0.4, (2, "z"): 0.9, (3, "x"): 0.6}


def test_near_duplicates(spark):
    rows = [(1, "a", 0.9, [1.0, 0.0, 0.0]), (1, "b", 0.8, [0.8, 0.6, 0.0]), (1, "c", 0.7, None)]
    df = ranked.ranked(spark.createDataFrame(rows, "query_id int, chunk_id string, score double, embedding array<float>"))
    assert context.remove_near_duplicates(df, 0.95).count() == 3
    assert [r.chunk_id for r in context.remove_near_duplicates(df, 0.5).orderBy("rank").collect()] == ["a", "c"]


def test_diversify_prefers_the_different(spark):
    rows = [(1, "a", 1.0, [1.0, 0.0]), (1, "b", 0.9, [1.0, 0.01]), (1, "c", 0.5, [0.0, 1.0])]
    df = ranked.ranked(spark.createDataFrame(rows, "query_id int, chunk_id string, score double, embedding array<float>"))
    assert [r.chunk_id for r in context.diversify(df, 3).orderBy("rank").collect()] == ["a", "c", "b"]


def test_grade(spark):
    df = run(spark, [(1, c, s) for c, s in zip("abcdef", [0.9, 0.6, 0.5, 0.4, 0.3, 0.2])])
    r = understanding.grade(df).first()
    assert r.confidence == pytest.approx(0.955) and r.level == "high"


def test_evaluation(spark):
    df = run(spark, [(1, "x", 3.0), (1, "r1", 2.0), (1, "r2", 1.0)])
    rel = spark.createDataFrame([(1, "r1"), (1, "r2"), (1, "r2")], "query_id int, chunk_id string")
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    m = {r.query_id: r for r in evaluation.metrics(df, rel, q, (3,)).collect()}
    assert m[1].rr == 0.5 and m[1].ap == pytest.approx((1 / 2 + 2 / 3) / 2) and m[1].p_3 == pytest.approx(2 / 3) and m[1].r_3 == 1
    assert m[1].ndcg_3 == pytest.approx((1 / math.log2(3) + 1 / 2) / (1 + 1 / math.log2(3))) and m[2].rr == m[2].ndcg_3 == 0


def test_vector_search_edges(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0]), ("e", [1.0, 0.0]), ("f", [0.5, 0.5])]
    c = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    assert [r.chunk_id for r in search.vector_top_k(c, q, 2).orderBy("rank").collect()] == ["a", "e"]
    assert search.vector_top_k(c, q.limit(0), 2).count() == 0 == search.vector_top_k(c.limit(0), q, 2).count()


def test_top_k_is_pushed_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS query_id", "cast(id AS string) AS chunk_id", "rand(1) AS score")
    assert "WindowGroupLimit" in ranked.top_k(df, 2)._jdf.queryExecution().executedPlan().toString()

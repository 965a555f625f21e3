import pytest

from corvine.operators import chunking, filters, graph, ingest
from corvine.sources import parsers
from corvine.sources.store import ChunkStore, IntegrityError, open_store
from pyspark.sql import functions as F


def test_diff(spark):
    s = "f string, hash string"
    old = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "c"), ("y", None)], s)
    new = spark.createDataFrame([("x", "a"), ("x", "b2"), ("x", "c"), ("x", "c"), ("y", "k")], s)
    got = {(r.f, r.hash): r.state for r in ingest.chunk_diff(old, new, ["f"]).collect()}
    assert got == {("x", "a"): "unchanged", ("x", "b"): "removed", ("x", "b2"): "added", ("x", "c"): "unchanged", ("y", "k"): "added"}


def test_upsert_and_delete(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    u = ingest.upsert(t, spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string"), ["k"])
    assert {tuple(r) for r in u.collect()} == {(1, "a"), (2, "B"), (3, "C")}
    assert ingest.delete(t, t.filter("k = 9"), ["k"]).count() == 2


def test_sweep(spark):
    j = spark.createDataFrame([("a", "queued", None), ("b", "running", None), ("c", "completed", None)], "job_id string, status string, error string")
    assert [r.status for r in ingest.sweep_orphans(j).orderBy("job_id").collect()] == ["failed", "failed", "completed"]


def test_chunkers():
    text = "This is a sentence. " * 100
    for f in (chunking.by_sentences, chunking.recursive):
        got = f(text, 50, 10, 1)
        assert len(got) > 1 and all(chunking.tokens(c) <= 50 for c in got)
    assert chunking.by_sentences("One. Two three.", 50, 10, 1) == ["One. Two three."]
    got = chunking.by_headings("# A\n\nx\n\n## B\n\ny\n\n# C\n\nz", 50, 10, 1)
    assert got == [("x", {"Header 1": "A"}), ("y", {"Header 1": "A", "Header 2": "B"}), ("z", {"Header 1": "C"})]


def test_strategy_and_blank(spark):
    df = spark.createDataFrame([("a.md", "# H\nx"), ("b.md", "x"), ("c.py", "x"), ("d.pdf", "x"), ("e.txt", " "), ("f.txt", None)], "filename string, text string")
    got = {r.filename: r.strategy for r in chunking.chunk_documents(df).collect()}
    assert got == {"a.md": "markdown", "b.md": "semantic", "c.py": "recursive", "d.pdf": "semantic"}


def test_filters(spark):
    df = spark.createDataFrame([("A.pdf", "12", None), ("b.md", "x", "Report")], "filename string, n string, t string")
    ids = lambda spec: [r.filename for r in df.filter(filters.predicate(spec, F.col)).collect()]
    assert ids({"filename": "a.p"}) == ["A.pdf"] and ids({"n": {"$gt": 3}}) == ["A.pdf"] and ids({"t": {"$regex": "REP"}}) == ["b.md"]
    assert ids({"t": {"$ne": "x"}}) == ["b.md"] and ids({"t": {"$odd": 1}}) == [] and ids({"t": {"$contains": "por"}}) == ["b.md"] and ids({"n": {"$range": [10, 13]}}) == ["A.pdf"] and ids({"n": {"$in": "12"}}) == []


def test_parsers(spark, tmp_path):
    assert parsers.html_text("<title>T</title><h2>H &amp; I</h2><script>x</script><p>a</p><li>b") == "# T\n\n## H & I\n\na\n\n- b"
    assert parsers.table_text("a,b\n1,2") == "| a | b |\n|---|---|\n| 1 | 2 |"
    rows = {r.filename: r for r in parsers.read_buffer(spark, [("x.md", b"# T\n## U"), ("y.bin", b"\x00"), ("e.md", b" "), ("t.tsv", b"a\tb\n1\t2")]).collect()}
    assert rows["x.md"].text == "# T\n## U" and rows["x.md"].metadata["title"] == "T" and rows["x.md"].metadata["headings"] == "2"
    assert rows["y.bin"].text is None and "bin" in rows["y.bin"].error and rows["e.md"].error and rows["t.tsv"].metadata == {"rows": "1", "columns": "a, b"}
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "sub" / "b.html").write_text("<title>T</title><p>x</p>")
    (tmp_path / "c.bin").write_bytes(b"?")
    assert {r.filename: r.text for r in parsers.read_directory(spark, str(tmp_path)).collect()} == {"a.txt": "one", "b.html": "# T\n\nx"}
    assert {r.filename for r in parsers.read_directory(spark, str(tmp_path), recursive=False, pattern="*.txt").collect()} == {"a.txt"}


def test_store(spark, tmp_path):
    s = ChunkStore(spark, f"file://{tmp_path}/store", 2)
    row = lambda i, e: (f"c{i}", "k", "f.md", i, "t", None, e)
    schema = "chunk_id string, collection_id string, filename string, chunk_index int, content string, metadata string, embedding array<float>"
    s.add(spark.createDataFrame([row(0, [1.0, 0.0]), row(1, [0.0, 1.0]), row(2, [1.0, 1.0])], schema))
    s.delete_chunks(spark.createDataFrame([("c1",), ("nope",)], "chunk_id string"))
    assert [r.chunk_id for r in s.file_chunks("f.md").collect()] == ["c0", "c2"]
    with pytest.raises(IntegrityError):
        s.add(spark.createDataFrame([row(9, [1.0])], schema))
    assert s.read().count() == 2
    before = s.read()
    s.add(spark.createDataFrame([row(1, [0.0, 2.0]), ("c0", "k", "f.md", 7, "new", None, [1.0, 0.0])], schema))
    assert before.count() == 2 and {r.chunk_id: r.chunk_index for r in s.read().collect()} == {"c0": 7, "c1": 1, "c2": 2}
    s.compact()
    assert len(s._segments()) == 1 and s.read().count() == 3
    q = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, embedding array<float>")
    assert [r.chunk_id for r in s.search(q, 2, F.col("chunk_id") != "c1").orderBy("rank").collect()] == ["c2", "c0"]
    s.delete_file("f.md", "other")
    assert s.read().count() == 3 and s.stats().first().chunks == 3
    s.delete_file("f.md")
    assert s.read().count() == 0
    with pytest.raises(ValueError):
        open_store("none", spark, "x", 2)


def test_graph(spark):
    m = spark.createDataFrame([("1", "A"), ("1", "B"), ("2", "A"), ("2", "B"), ("3", "C"), ("3", "B")], "chunk_id string, name string")
    e = graph.co_occurrence(m)
    assert {(r.src, r.dst): r.weight for r in e.collect()} == {("A", "B"): 2, ("B", "A"): 2, ("B", "C"): 1, ("C", "B"): 1}
    assert {r.name: r.hops for r in graph.expand(e, spark.createDataFrame([("A",)], "name string"), 2).collect()} == {"A": 0, "B": 1, "C": 2}
    p = {r.name: r.importance for r in graph.page_rank(e, 30).collect()}
    assert sum(p.values()) == pytest.approx(1) and p["B"] > p["A"] > p["C"]

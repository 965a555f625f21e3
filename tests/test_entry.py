"""Every core query runs on the smallest data; the SQL it comes with names the same columns."""

import pytest

from corvine.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_runs(spark, tiny, name):
    df = catalog.QUERIES[name](spark, tiny)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_streamed_ingest_is_idempotent(spark, tmp_path):
    from corvine.streaming.flows import ingest_stream

    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    one = spark.createDataFrame([("a.txt", "One. Two."), ("a.txt", "One. Two."), ("b.txt", None)], "filename string, text string")
    one.write.parquet(src)
    ingest_stream(spark, src, out, ck).awaitTermination(120)
    one.write.mode("append").parquet(src)
    ingest_stream(spark, src, out, ck).awaitTermination(120)
    assert spark.read.parquet(f"{out}/chunks").count() == 1

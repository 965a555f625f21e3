"""Vectors of texts: encoders as callables, a cache of what was encoded, features
of a chunk's structure, checks of length, and projections to draw."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What models of some families want before a query and before a passage.
PREFIXES = {"e5": ("query: ", "passage: "), "bge": ("Represent this sentence for searching relevant passages: ", "")}
#: The share of structure in a vector by kind of query.
STRUCTURE_SHARE = {"factual": 0.1, "navigational": 0.5, "exploratory": 0.3}


def provider(model: str) -> str:
    """Where a model's name says it comes from."""
    return "local-server" if ":" in model else "hub" if "/" in model or model.startswith(("bge-", "e5-")) else "default"


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """An encoder without a model: each word adds to one dimension by its hash,
    with the sign of another bit; vectors have length 1. For tests and as a
    stand-in; a text without a word is all zero."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    return encode


def encode(df: DataFrame, key: str, text: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]], model: str = "", is_query: bool = False) -> DataFrame:
    """``(key, embedding)`` of texts. ``encoder`` makes the function once a task,
    so a model is loaded once. Null texts have null vectors."""
    before = next((p[0 if is_query else 1] for k, p in PREFIXES.items() if k in model.lower()), "")
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = encoder()
        for b in batches:
            some = b["t"].notna()
            v: list = [None] * len(b)
            for i, e in zip(np.flatnonzero(some), f([before + t for t in b["t"][some]]) if some.any() else ()):
                v[i] = e.tolist()
            yield pd.DataFrame({"k": b["k"], "e": v})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, e array<float>").select(F.col("k").alias(key), F.col("e").alias("embedding"))


def cache_key(text: Column, model: str) -> Column:
    return F.concat(F.lit(f"emb:{model}:"), F.substring(F.sha2(text, 256), 1, 16))


def encode_missing(df: DataFrame, key: str, text: str, cache: DataFrame, encoder: Callable, model: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of all texts, and what to add to the ``cache(cache_key, embedding)``:
    each text that is not in it is encoded once."""
    d = df.select(key, F.col(text).alias("t"), cache_key(F.col(text), model).alias("cache_key"))
    new = d.filter("t is not null").groupBy("cache_key").agg(F.min("t").alias("t")).join(cache.select("cache_key"), "cache_key", "left_anti")
    fresh = encode(new, "cache_key", "t", encoder, model)
    return d.join(cache.select("cache_key", "embedding").unionByName(fresh), "cache_key", "left").select(key, "embedding"), fresh


def structure(text: Column, title: Column, section: Column, page: Column) -> Column:
    """Eight features of a chunk's structure, each between 0 and 1: headings, list
    items, code, length, capitals, title, section, page."""
    lines = lambda p: F.regexp_count(text, F.lit(f"(?m){p}"))
    upto = lambda c, n: F.least(c / n, F.lit(1.0))
    letters = F.length(F.regexp_replace(text, r"\s", ""))
    return F.array(
        upto(lines(r"^#+\s"), 5.0), upto(lines(r"^\s*(?:[-*+]|\d+\.)\s"), 10.0), F.when(F.contains(text, F.lit("```")), 1.0).otherwise(0.0), upto(F.length(text), 2000.0),
        F.when(letters > 0, F.regexp_count(text, F.lit(r"\p{Lu}")) / letters).otherwise(0.0), F.when(title.isNotNull(), 1.0).otherwise(0.0), F.when(section.isNotNull(), 1.0).otherwise(0.0),
        upto(F.coalesce(page.cast("double"), F.lit(0.0)), 100.0),
    )


def _unit(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.when(n > 0, n).otherwise(1.0))


def with_structure(embedding: Column, features: Column, share: Column | float) -> Column:
    """An embedding with ``share`` of its structure: the features repeated to the
    embedding's length, both of length 1, added and scaled again."""
    w = share if isinstance(share, Column) else F.lit(float(share))
    e = F.transform(embedding, lambda x: x.cast("double"))
    tiled = F.transform(F.sequence(F.lit(0), F.size(embedding) - 1), lambda i: F.get(features, i % F.size(features)))
    return _unit(F.zip_with(_unit(e), _unit(tiled), lambda a, b: (1 - w) * a + w * b))


def structure_share(kind: Column) -> Column:
    out = F.lit(0.2)
    for k, v in STRUCTURE_SHARE.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def too_long(df: DataFrame, text: str, most_tokens: int) -> DataFrame:
    """One row: how many texts a model of ``most_tokens`` would cut, and the
    longest. Texts of up to ``2 * most_tokens`` characters are never counted."""
    n = F.floor(F.length(text) / 4)
    return df.filter(F.length(text) > 2 * most_tokens).agg(F.count_if(n > most_tokens).alias("truncated"), F.coalesce(F.max(n), F.lit(0)).cast("int").alias("longest"))


def project(df: DataFrame, key: str, embedding: str, dim: int = 2) -> DataFrame:
    """``(key, point)``: vectors on the axes of their greatest variance, for a
    picture. The covariance is summed where the vectors are; vectors of another
    length than the first are left out. A linear stand-in for a manifold."""
    first = df.filter(F.col(embedding).isNotNull()).select(F.size(embedding)).first()
    kind = dict(df.dtypes)[key]
    schema = f"k {kind}, point array<double>"
    if first is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("k", key)
    n = first[0]
    d = df.filter(F.size(embedding) == n).select(F.col(key).alias("k"), F.col(embedding).cast("array<double>").alias("e"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, square, count = np.zeros(n), np.zeros((n, n)), 0
        for b in batches:
            if len(b):
                x = np.stack(b["e"].to_numpy())
                total, square, count = total + x.sum(0), square + x.T @ x, count + len(x)
        yield pd.DataFrame({"s": [np.concatenate([[count], total, square.ravel()]).tolist()]})

    rows = d.mapInPandas(sums, "s array<double>").select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()["x"].to_numpy()
    count, mean = rows[0], rows[1 : n + 1] / max(1.0, rows[0])
    value, axes = np.linalg.eigh(rows[n + 1 :].reshape(n, n) / max(1.0, count) - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :dim]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(dim)] < 0, -1, 1)  # one sign, whoever computes it

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "point": ((np.stack(b["e"].to_numpy()) - mean) @ axes).tolist() if len(b) else []})

    return d.mapInPandas(place, schema).withColumnRenamed("k", key)

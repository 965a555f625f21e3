"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def whitespace_tokens(c: Column) -> Column:
    """Lower-cased tokens between white space; null gives null, empty text no token."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != "")


def word_tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), 1)


def char_bigrams(c: Column) -> Column:
    """Overlapping pairs of characters, for scripts without spaces."""
    return F.when(F.length(c) < 2, F.array(c)).otherwise(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))


#: Languages written without spaces, and families.
UNSPACED = ["zh", "ja", "th", "lo", "my", "km"]
CJK = ["zh", "ja", "ko"]
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no"],
    "romance": ["fr", "es", "it", "pt", "ro"],
    "slavic": ["ru", "pl", "cs", "uk", "bg"],
    "cjk": ["zh", "ja", "ko"],
    "semitic": ["ar", "he"],
}
#: Words that tell a language.
TELLING = {
    "en": ["the", "and", "of", "is", "to", "that", "with", "for"],
    "fr": ["le", "la", "les", "et", "est", "des", "une", "que"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "mit"],
    "es": ["el", "los", "las", "y", "es", "una", "que", "con"],
    "pt": ["o", "os", "as", "e", "um", "uma", "não", "com"],
}


def is_cjk(language: Column) -> Column:
    return F.coalesce(language.isin(*CJK), F.lit(False))


def is_unspaced(language: Column) -> Column:
    """Whether a language needs another cut into tokens than at white space."""
    return F.coalesce(language.isin(*UNSPACED), F.lit(False))


def language_family(language: Column) -> Column:
    return F.coalesce(*[F.when(language.isin(*xs), F.lit(f)) for f, xs in FAMILIES.items()], F.lit("other"))


def _without(words: Column, some: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*some))


def detect_language(text: Column) -> Column:
    """Struct of ``language`` and ``confidence``: the script, or for Latin letters
    the language with most telling words. Blank texts are English with 0, texts
    without any sign English with 0.5. Only a first guess for routing."""
    share = lambda p: F.regexp_count(text, F.lit(p)) / F.greatest(F.length(F.regexp_replace(text, r"\s", "")), F.lit(1))
    scripts = [("ja", r"[\x{3040}-\x{30ff}]", 0.1), ("zh", r"[\x{4e00}-\x{9fff}]", 0.3), ("ko", r"[\x{ac00}-\x{d7af}]", 0.3), ("th", r"[\x{0e00}-\x{0e7f}]", 0.3), ("ru", r"[\x{0400}-\x{04ff}]", 0.3), ("hi", r"[\x{0900}-\x{097f}]", 0.3), ("ar", r"[\x{0600}-\x{06ff}]", 0.3)]
    words = whitespace_tokens(text)
    votes = [(x, F.size(words) - F.size(_without(words, ws))) for x, ws in TELLING.items()]
    best = F.greatest(*(n for _, n in votes))
    latin = F.coalesce(*[F.when((n == best) & (best > 0), F.lit(x)) for x, n in votes], F.lit("en"))
    sure = F.when(best > 0, F.least(F.lit(1.0), 0.5 + best / F.greatest(F.size(words), F.lit(1)))).otherwise(0.5)
    kind = F.coalesce(*[F.when(share(p) > least, F.struct(F.lit(x).alias("language"), F.lit(0.95).alias("confidence"))) for x, p, least in scripts], F.struct(latin.alias("language"), sure.alias("confidence")))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.struct(F.lit("en").alias("language"), F.lit(0.0).alias("confidence"))).otherwise(kind)


def language_tokens(text: Column, language: Column, stop: dict[str, list[str]] | None = None) -> Column:
    """Lower-cased tokens of a text in its language: pairs of characters where
    there are no spaces, else words without the language's stop words. Null
    texts have none."""
    words = word_tokens(text)
    for x, ws in (stop or {}).items():
        if ws:
            words = F.when(language == x, _without(words, ws)).otherwise(words)
    pairs = F.flatten(F.transform(words, char_bigrams))
    return F.coalesce(F.when(is_unspaced(language), pairs).otherwise(words), F.array().cast("array<string>"))


def digest(c: Column, bits: int = 256) -> Column:
    """Hexadecimal hash of a text, SHA-2 or, with 128 bits, MD5."""
    return F.md5(c) if bits == 128 else F.sha2(c, bits)


def token_count(c: Column) -> Column:
    """Tokens of a text, four characters each."""
    return F.floor(F.length(c) / 4).cast("int")


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` stands in ``text`` without overlap; 0 for an empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one is all zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def distance_similarity(d: Column) -> Column:
    """Similarity of a distance: 1 at 0, falling towards 0."""
    return 1.0 / (1.0 + d)


def file_name(path: Column) -> Column:
    """Last part of a path, at most 255 characters."""
    return F.substring(F.regexp_extract(path, r"([^/\\]+)$", 1), 1, 255)


def register(spark) -> None:
    """SQL names for what plain SQL lacks."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION token_count(t STRING) RETURNS INT RETURN CAST(floor(length(t) / 4) AS INT)")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION dot_product(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    )

"""Metadata filters as column predicates."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.storage import bounded


def _literal(c: Column, value: Any, op: str, kind: str) -> Column:
    """A comparison in the column's own type where that is possible, so that it
    reaches the scan; text is compared with numbers as a number, if it is one."""
    if isinstance(value, bool):
        right = F.lit(value) if kind == "boolean" else F.lit(str(value).lower())
        left = c if kind in ("boolean", "string") else c.cast("string")
    elif isinstance(value, (int, float)):
        numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        left = c if numeric else c.try_cast("double")
        whole = isinstance(value, int) or float(value).is_integer()
        right = F.lit(int(value)).cast(kind) if numeric and kind in ("tinyint", "smallint", "int", "bigint") and whole and abs(value) < 1 << 31 else F.lit(float(value))
    else:
        left, right = (c if kind == "string" else c.cast("string")), F.lit(str(value))
    return {"$gte": left >= right, "$lte": left <= right, "$gt": left > right, "$lt": left < right, "$ne": left != right, "$eq": left == right}[op]


def predicate(spec: dict[str, Any], field, kinds: dict[str, str] | None = None) -> Column:
    """A predicate for ``{key: value}`` and ``{key: {op: value}}``.

    ``field(key)`` gives a key's column, null where it is missing, and ``kinds``
    its type where that is no text. All keys and operators must hold; a missing
    key, a value of the wrong type and an unknown operator don't: the predicate
    is null or false. ``filename`` given plainly means a part of the name in
    any case; ``$regex`` and ``$contains`` ignore case.
    """
    out = F.lit(True)
    for key, want in spec.items():
        c, kind = field(key), (kinds or {}).get(key, "string")
        text = c if kind == "string" else c.cast("string")
        for op, value in want.items() if isinstance(want, dict) else [("", want)]:
            if op == "":
                p = F.contains(F.lower(text), F.lit(str(value).lower())) if key == "filename" else _literal(c, value, "$eq", kind)
            elif op in ("$gte", "$lte", "$gt", "$lt", "$ne", "$eq"):
                p = _literal(c, value, op, kind)
            elif op == "$in":
                p = text.isin([str(v) for v in value]) if isinstance(value, (list, tuple)) and value else F.lit(False)
            elif op == "$regex":
                p = text.rlike(f"(?i){value}")
            elif op == "$contains":
                p = F.contains(F.lower(text), F.lit(str(value).lower()))
            elif op == "$range":
                p = _literal(c, value[0], "$gte", kind) & _literal(c, value[1], "$lte", kind)
            else:
                p = F.lit(False)
            out = out & p
    return out


def json_field(column: str):
    """Fields of a JSON text column."""
    return lambda key: F.get_json_object(F.col(column), f"$.{key}")


OPERATORS = {"eq": "$eq", "ne": "$ne", "gt": "$gt", "lt": "$lt", "gte": "$gte", "lte": "$lte", "in": "$in", "contains": "$contains", "regex": "$contains", "range": "$range"}


def where(filters: list[tuple[str, str, Any]], field, kinds: dict[str, str] | None = None) -> Column:
    """A predicate for ``(field, operator, value)`` rows, all of which must hold.
    ``regex`` means a part of the text here, as ``contains`` does; an operand of
    the wrong form and an unknown operator leave their row out."""
    out = F.lit(True)
    for name, op, value in filters:
        if op not in OPERATORS or op == "in" and not isinstance(value, list) or op == "range" and not (isinstance(value, (list, tuple)) and len(value) == 2):
            continue
        out = out & predicate({name: {OPERATORS[op]: value}}, field, kinds)
    return out


def to_sql(spec: dict[str, Any], column: str = "metadata") -> str:
    """The filter as SQL over a JSON text column, for stores that take a string."""
    quote = lambda v: "'" + str(v).replace("'", "''") + "'"
    sign = {"$gte": ">=", "$lte": "<=", "$gt": ">", "$lt": "<", "$ne": "<>", "$eq": "="}
    parts = []
    for key, want in spec.items():
        text = f"get_json_object({column}, {quote('$.' + key)})"
        for op, value in want.items() if isinstance(want, dict) else [("$eq" if key != "filename" else "$contains", want)]:
            number = isinstance(value, (int, float)) and not isinstance(value, bool)
            if op in sign:
                parts.append(f"try_cast({text} AS DOUBLE) {sign[op]} {float(value)}" if number else f"{text} {sign[op]} {quote(str(value).lower() if isinstance(value, bool) else value)}")
            elif op == "$in" and isinstance(value, (list, tuple)) and value:
                parts.append(f"{text} IN ({', '.join(quote(v) for v in value)})")
            elif op == "$contains":
                parts.append(f"contains(lower({text}), {quote(str(value).lower())})")
            elif op == "$regex":
                parts.append(f"regexp({text}, {quote('(?i)' + value)})")
            else:
                parts.append("false")
    return " AND ".join(parts) or "true"


# Kinds of documents in the order they are looked for, and the words for each.
DOC_TYPES = [
    ("report", r"\b(report|annual report|quarterly report)\b"),
    ("policy", r"\b(policy|policies|guideline)\b"),
    ("contract", r"\b(contract|agreement|terms)\b"),
    ("invoice", r"\b(invoice|bill|receipt)\b"),
    ("manual", r"\b(manual|guide|documentation)\b"),
    ("specification", r"\b(spec|specification|requirements?)\b"),
]
YEAR = r"\b(20\d{2}|19\d{2})\b"
QUARTER = r"\b(?:q|quarter\s+)([1-4])\b"
SECTION = r"\b(?:in|from)\s+(?:the\s+)?(\w+)\s+section\b"
FILE = r"""\b(?:from|in)\s+(?:document|file)\s+["']?([^"']+)["']?\b"""
TABLE = r"\btable\b"


def implied(query: Column) -> Column:
    """Filters a query's words imply, null where there are none: year, quarter,
    kind of document (the first that is named), section, file name, tables."""
    found = lambda p: F.nullif(F.regexp_extract(query, f"(?i){p}", 1), F.lit(""))
    kind = F.coalesce(*[F.when(query.rlike(f"(?i){p}"), F.lit(w)) for w, p in DOC_TYPES])
    return F.struct(
        found(YEAR).cast("int").alias("date_year"),
        found(QUARTER).cast("int").alias("quarter"),
        kind.alias("doc_type"),
        found(SECTION).alias("section"),
        found(FILE).alias("filename"),
        F.when(query.rlike(f"(?i){TABLE}"), True).otherwise(False).alias("is_table"),
    )


def matching(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """``(query_id, *rows)``: the rows that pass the filters implied by each
    query's ``text``. Years and quarters are joined on, names compared after;
    a filter that a query doesn't imply lets everything pass. Takes ``rows`` with
    any of the columns ``date_year, quarter, doc_type, section, filename,
    is_table``; the queries are a query set, broadcast if small."""
    f = bounded(queries.select("query_id", implied(F.col("text")).alias("f")).select("query_id", *[F.col(f"f.{x}").alias(f"_{x}") for x in ("date_year", "quarter", "doc_type", "section", "filename", "is_table")]))
    part = lambda c: F.col(f"_{c}").isNull() | F.contains(F.lower(c), F.lower(f"_{c}"))
    on = F.lit(True)
    for c in rows.columns:
        if c in ("date_year", "quarter"):
            on = on & (F.col(f"_{c}").isNull() | (F.col(c) == F.col(f"_{c}")))
        elif c in ("doc_type", "section", "filename"):
            on = on & part(c)
        elif c == "is_table":
            on = on & (~F.col("_is_table") | F.col(c))
    return rows.join(f, on).select("query_id", *rows.columns)

"""Names by domain: patterns and word lists of several fields, rows of one's own
beside them, and merging with other sources of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values: (pattern, kind, priority) by domain.
PATTERNS: dict[str, list[tuple[str, str, int]]] = {
    "medical": [
        (r"\b\w+(?:mycin|cillin|cycline|oxacin|azole|olol|pril|sartan|statin)\b", "MEDICATION", 3),
        (r"\b(?:cancer|diabetes|hypertension|infection|syndrome|disease|disorder)\b", "DISEASE", 2),
        (r"\b(?:surgery|biopsy|MRI|CT scan|X-ray|ultrasound|endoscopy|angioplasty)\b", "PROCEDURE", 2),
        (r"\b(?:fever|pain|nausea|fatigue|headache|dizziness|bleeding)\b", "SYMPTOM", 1),
        (r"\b(?:WBC|RBC|hemoglobin|glucose|cholesterol|creatinine|ALT|AST)\s*[:<>=]\s*[\d.]+", "LAB_VALUE", 3),
    ],
    "legal": [
        (r"\b(?:[A-Z][a-z]+\s+v\.?\s+[A-Z][a-z]+|\d+\s+U\.S\.\s+\d+)", "CASE_NAME", 3),
        (r"\b\d+\s+U\.S\.C\.\s*§?\s*\d+(?:\([a-z]\d*\))?", "STATUTE", 3),
        (r"\b(?:contract|agreement|deed|will|trust|motion|complaint|brief)\b", "LEGAL_DOCUMENT", 2),
        (r"\b(?:plaintiff|defendant|appellant|appellee|jurisdiction|precedent)\b", "LEGAL_TERM", 1),
    ],
    "financial": [
        (r"\b[A-Z]{2,5}\b(?=\s*(?:stock|shares|equity))", "TICKER", 3),
        (r"\b(?:EBITDA|P/E|EPS|ROI|ROE|revenue|profit|loss|assets|liabilities)\b", "FINANCIAL_METRIC", 2),
        (r"\$[\d,]+(?:\.\d{2})?(?:\s*(?:million|billion|trillion|M|B|T))?", "CURRENCY", 3),
        (r"\b(?:bond|stock|equity|derivative|option|future|swap|security)\b", "FINANCIAL_INSTRUMENT", 2),
    ],
    "technical": [
        (r"\b(?:Python|Java|JavaScript|TypeScript|C\+\+|Rust|Go|Ruby|PHP|Swift|Kotlin)\b", "PROGRAMMING_LANGUAGE", 2),
        (r"\b(?:React|Vue|Angular|Django|Flask|Spring|TensorFlow|PyTorch|Keras)\b", "FRAMEWORK", 2),
        (r"\b(?:HTTP|HTTPS|FTP|SSH|TCP|UDP|IP|DNS|SMTP|WebSocket)\b", "PROTOCOL", 2),
        (r"/api/v?\d+/[\w/]+", "API_ENDPOINT", 3),
        (r"\bv?\d+\.\d+(?:\.\d+)?(?:-(?:alpha|beta|rc)\.\d+)?", "VERSION", 1),
    ],
    "academic": [
        (r"\b(?:RCT|meta-analysis|systematic review|case study|survey|experiment)\b", "METHODOLOGY", 2),
        (r"\b(?:p-value|confidence interval|standard deviation|correlation|regression)\b", "STATISTICAL_TERM", 2),
        (r"\b(?:University of|Institute of|College of)\s+[A-Z][a-z]+", "INSTITUTION", 3),
        (r"\([A-Z][a-z]+(?:\s+et al\.)?,\s*\d{4}\)", "CITATION", 2),
    ],
}
PATTERNS["scientific"] = PATTERNS["academic"]
# Words by kind and domain.
WORDS: dict[str, dict[str, list[str]]] = {
    "medical": {
        "DISEASE": ["COVID-19", "influenza", "pneumonia", "tuberculosis", "malaria", "HIV", "AIDS", "Alzheimer's", "Parkinson's", "asthma", "COPD", "arthritis", "osteoporosis"],
        "MEDICATION": ["aspirin", "ibuprofen", "acetaminophen", "amoxicillin", "metformin", "insulin", "warfarin", "prednisone"],
    },
    "financial": {"FINANCIAL_TERM": ["IPO", "merger", "acquisition", "dividend", "stock split", "earnings call", "SEC filing", "10-K", "10-Q", "8-K", "balance sheet", "income statement", "cash flow"]},
    "technical": {"TECHNOLOGY": ["API", "REST", "GraphQL", "microservices", "serverless", "container", "Kubernetes", "Docker", "CI/CD", "machine learning", "deep learning", "neural network"]},
}


def domain_names(chunks: DataFrame, domain: str, patterns: list[tuple[str, str, int]] = (), words: dict[str, list[str]] | None = None) -> DataFrame:
    """``(chunk_id, name, kind, mentions)`` of ``chunks(chunk_id, text)``.

    A domain's patterns in the order of their priority, then its words, all
    whatever their case; ``patterns`` and ``words`` of one's own count as well.
    Spellings that differ in case are one name: the first found names it and its
    kind, ``mentions`` has all of them. Matches of one character don't count.
    """
    rules = sorted([*PATTERNS.get(domain, []), *patterns], key=lambda r: -r[2])
    lists = {k: list(v) for k, v in WORDS.get(domain, {}).items()}
    for k, v in (words or {}).items():
        lists[k] = [*lists.get(k, []), *v]
    text = F.col("text")

    def matches(k: int, pattern: str, kind: str):
        return F.transform(F.regexp_extract_all(text, F.lit(f"(?i)({pattern})"), 1), lambda m, i: F.struct(F.lit(k).alias("rule"), i.cast("int").alias("at"), m.alias("mention"), F.lit(kind).alias("kind")))

    hits = [matches(k, p, kind) for k, (p, kind, _) in enumerate(rules)]
    flat = [(w, kind) for kind, ws in lists.items() for w in dict.fromkeys(ws)]
    hits += [F.array(*[F.when(F.contains(F.lower(text), F.lit(w.lower())), F.struct(F.lit(len(rules)).alias("rule"), F.lit(k).alias("at"), F.lit(w).alias("mention"), F.lit(kind).alias("kind"))) for k, (w, kind) in enumerate(flat)])] if flat else []
    if not hits:
        return chunks.sparkSession.createDataFrame([], f"chunk_id {dict(chunks.dtypes)['chunk_id']}, name string, kind string, mentions array<string>")
    found = chunks.filter("text is not null").select("chunk_id", F.explode(F.filter(F.concat(*hits), lambda h: h.isNotNull() & (F.length(h["mention"]) >= 2))).alias("h")).distinct()
    g = found.groupBy("chunk_id", F.lower("h.mention").alias("low")).agg(F.min("h").alias("first"), F.array_sort(F.collect_set("h.mention")).alias("mentions"))
    return g.select("chunk_id", F.col("first.mention").alias("name"), F.col("first.kind").alias("kind"), "mentions")


def merge_names(general: DataFrame, domain: DataFrame, how: str = "union") -> DataFrame:
    """``(chunk_id, name, kind)`` of two sources, each name of a chunk once
    whatever its case: the general source's is kept, or with ``domain_first`` the
    domain's."""
    first = 0 if how == "domain_first" else 2
    both = general.select("chunk_id", "name", "kind", F.lit(1).alias("place")).unionByName(domain.select("chunk_id", "name", "kind", F.lit(first).alias("place")))
    w = W.partitionBy("chunk_id", F.lower("name")).orderBy("place", "name", "kind")
    return both.withColumn("n", F.row_number().over(w)).filter("n = 1").select("chunk_id", "name", "kind")

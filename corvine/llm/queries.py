"""The pN_ queries and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from corvine.llm import batches, languages, leakage, markup, neardup, neighbours, packing, scans, sentences, splitting

QUERIES = {
    "p1_found": scans.found_query,
    "p1_repaired": scans.repaired_query,
    "p2_found": languages.found_query,
    "p2_segments": languages.segments_query,
    "p3_found": neardup.found_query,
    "p3_groups": neardup.groups_query,
    "p3_chunk_groups": neardup.chunk_groups_query,
    "p4_found": batches.found_query,
    "p5_found": splitting.found_query,
    "p5_pieces": splitting.pieces_query,
    "p5_files": splitting.files_query,
    "p6_found": markup.found_query,
    "p6_clean": markup.clean_query,
    "p7_found": neighbours.found_query,
    "p7_nearest": neighbours.nearest_query,
    "p8_packing": packing.packing_query,
    "p9_found": leakage.found_query,
    "p9_edited": leakage.edited_query,
    "p10_found": sentences.found_query,
    "p10_units": sentences.units_query,
}

SQL = {
    "p3_found": r"""
        WITH c AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(content), '[\p{L}\p{N}_]+') AS w FROM chunks),
        s AS (SELECT DISTINCT chunk_id, array_to_string(w[k : k + 2], ' ') AS g
              FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS k FROM c WHERE len(w) >= 30)),
        n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.chunk_id < b.chunk_id GROUP BY ALL)
        SELECT p.a AS chunk_id_a, p.b AS chunk_id_b FROM p JOIN n x ON x.chunk_id = p.a JOIN n y ON y.chunk_id = p.b WHERE k / (x.n + y.n - k) >= 0.6""",
    "p5_found": """
        SELECT 'documents' AS src, CAST(doc_id AS VARCHAR) AS rec_id FROM documents WHERE length(text) // 4 > 450
        UNION SELECT 'chunks', chunk_id FROM chunks WHERE length(content) // 4 > 450""",
    "p9_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM eval_items),
        iw AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 9], ' ') AS run
               FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i WHERE len(w) >= 10)),
        dw AS (SELECT doc_id, array_to_string(w[k : k + 9], ' ') AS run
               FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d WHERE len(w) >= 10))
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (run)""",
}

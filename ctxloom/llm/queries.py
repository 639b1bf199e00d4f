"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from ctxloom.llm import archive, fingerprint, mixing, nearjoin, neighbours, packing, personal, quality, substrings, toxicity

QUERIES = {
    "op1_fingerprint": fingerprint.op1_fingerprint,
    "op2_mix": mixing.op2_mix,
    "op3_pack": packing.op3_pack,
    "op4_quality": quality.op4_quality,
    "op5_personal": personal.op5_personal,
    "op6_warc": archive.op6_warc,
    "op7_near_duplicates": nearjoin.op7_near_duplicates,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_nearest": neighbours.op9_nearest,
    "op10_substrings": substrings.op10_substrings,
}

ORACLE_SQL: dict[str, str] = {
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        r AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
                     max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
        FROM r""",
    "op9_nearest": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x) AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
}

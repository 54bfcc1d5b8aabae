"""DuckDB SQL for the corpus queries that SQL expresses. It is meant for small tables: it makes every window and shared shingle a row."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WHITE, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

WARC = """
    WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, p.payload_digest,
        CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""

TOP_K = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

SUBSTRINGS = f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WHITE}') AS ws FROM documents),
    win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 12, 0) + 1)) AS i FROM w)),
    f AS (SELECT t, min(doc_id) AS first_id FROM win GROUP BY t),
    gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i FROM win JOIN f ON win.t = f.t WHERE first_id < doc_id), range(13) AS r(j)),
    n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
    placed AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
    FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

DECONTAMINATE = rf"""
    WITH i AS (SELECT item_id, regexp_extract_all({LOWER}, '{ALNUM}') AS ws FROM benchmark WHERE item_id IS NOT NULL),
    iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS t
        FROM (SELECT item_id, ws, least(8, len(ws)) AS n, unnest(range(1, len(ws) - least(8, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
    d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS ws FROM documents),
    dw AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS t
        FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(len(ws) - n + 1, 0) + 1)) AS p FROM d, (SELECT DISTINCT n FROM iw))),
    m AS (SELECT DISTINCT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
    h AS (SELECT doc_id, count(DISTINCT p + j) AS n_hit FROM m, range(8) AS r(j) WHERE j < n GROUP BY doc_id),
    f AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
        sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
    FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN f ON d.doc_id = f.doc_id
"""

MINHASH = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WHITE}') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 1], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS p FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s AS a JOIN s AS b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
    link AS (SELECT a, b FROM pair JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)),
    edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
    c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
    SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
    FROM w JOIN c ON w.doc_id = c.a LEFT JOIN n ON w.doc_id = n.doc_id
"""

ORACLE_SQL = {"op1_warc": WARC, "op3_topk": TOP_K, "op5_substrings": SUBSTRINGS, "op6_decontaminate": DECONTAMINATE, "op8_minhash": MINHASH}

"""DuckDB SQL for the queries that SQL expresses over whole tables."""

SQL: dict[str, str] = {
    # a turn is <|ROLE|>TEXT<|end|>: 11 characters besides role and text, one more for each escaped place
    "op2_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
            CAST(sum(length(role) + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) + 11) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    # a row's version is that of its arrival, told by the manifest and kept through all merges; no tier is left to merge
    "op9_shards": """
        SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS text_bytes, md5(text) AS text_md5,
            CAST(1 + coalesce((doc_id % 8 + 8) % 8, 0) AS BIGINT) AS added_version, true AS tiers_settled FROM documents
    """,
    "op4_near_dup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
        u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT r.d, u.y FROM r JOIN u ON u.x = r.m)
        SELECT d AS doc_id, coalesce(max(n), 0) AS n_shingles, min(m) AS component_id, d = min(m) AS kept FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d
    """,
    "op8_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
        ),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
        ),
        v AS (SELECT item_id, ws, least(len(ws), 10) AS size FROM b WHERE len(ws) > 0),
        k AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM v)),
        z AS (SELECT DISTINCT size FROM k),
        p AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS win FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, z WHERE len(ws) >= size)),
        h AS (SELECT p.doc_id, p.i, p.size, k.item_id FROM p JOIN k ON p.size = k.size AND p.win = k.win),
        t AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS q FROM h) GROUP BY 1),
        m AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
    """,
    # a SHA-1 in base32: five hexadecimal digits are four of its characters
    "op11_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
        m AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS head FROM p)
        SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS INTEGER) // CAST(2 ** (15 - 5 * (i % 4)) AS INTEGER)) % 32 AS BIGINT), 1)), '') AS payload_digest,
            CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM m
    """,
    # all terms of all pairs, zeros too
    "op12_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        o AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
        c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY 1, 2, 3),
        v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
        g AS (SELECT DISTINCT lang, source FROM d),
        x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        s AS (SELECT lang, source, sum(n) AS n FROM x GROUP BY 1, 2),
        p AS (SELECT x.lang, x.source, x.term, x.n, CAST(1 + (1000000000 * (CAST(x.n AS HUGEINT) + 2)) // (s.n + 2 * v.v) AS BIGINT) AS p, CAST(1 + (1000000000 * (CAST(x.n_lang AS HUGEINT) + 2)) // (v.n + 2 * v.v) AS BIGINT) AS q
            FROM x JOIN s ON s.lang = x.lang AND s.source = x.source JOIN v ON v.lang = x.lang),
        f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
        SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank FROM y WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR rank <= 10
    """,
}

"""DuckDB SQL for the queries that SQL can express."""

ORACLE = {
    # The pages of the tables keep their main text in one article of h1 and p elements; blocks are
    # joined by two line feeds.
    "op3_html_extraction": r"""
        WITH articles AS (
            SELECT page_id, url,
                   regexp_extract(html, '(?s)<article>(.*?)(?:</article>|\z)', 1) AS body
            FROM pages
        ), blocks AS (
            SELECT page_id, url, list_transform(
                regexp_split_to_array(body, '</?(?:h1|p)>'),
                lambda b: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                    b, '<br>', ' ', 'g'), '<[^>]*(?:>|\z)', '', 'g'), '&quot;?', '"', 'g'), '\s+', ' ', 'g'))
            ) AS b
            FROM articles
        ), texts AS (
            SELECT page_id, url, coalesce(array_to_string(list_filter(list_transform(
                b, lambda x: regexp_replace(x, '&amp;?', '&', 'g')), lambda x: x <> ''), chr(10) || chr(10)), '') AS text
            FROM blocks
        )
        SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
    """,
    "op7_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
            FROM words, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS t(i)
            WHERE len(w) > 0
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), links AS (
            SELECT a.doc_id AS x, b.doc_id AS y
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, p.n, q.n
            HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
        ), reach AS (
            SELECT doc_id AS x, doc_id AS y FROM documents
            UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
        )
        SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id
        FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.x = d.doc_id
        GROUP BY d.doc_id
    """,
    # Two hexadecimal digits stand for a byte, 400 for a window.
    "op11_suffix_array_dedup": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), windows AS (
            SELECT r, i, md5(substr(h, (2 * i + 1)::INT, 400)) AS w
            FROM docs, unnest(range(0, length(h) // 2 - 199)) AS t(i)
            WHERE length(h) >= 400
        ), again AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1
        ), starts AS (
            SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before
            FROM windows SEMI JOIN again USING (w)
        ), numbered AS (
            SELECT r, i, sum(CASE WHEN before IS NULL OR i - before > 200 THEN 1 ELSE 0 END)
                OVER (PARTITION BY r ORDER BY i) AS span
            FROM starts
        ), spans AS (
            SELECT r, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY r, span
        ), edges AS (
            SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM spans
        ), cut AS (
            SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail,
                string_agg(substr(h, (2 * p + 1)::INT, (2 * (a - p))::INT), '' ORDER BY a) AS head
            FROM edges JOIN docs USING (r) GROUP BY r
        )
        SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
            coalesce(n_spans, 0)::BIGINT AS n_spans,
            sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(tail, 0) + 1)::INT))) AS kept_sha256
        FROM docs LEFT JOIN cut USING (r)
    """,
    "op13_filter_audit": r"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
        ), firsts AS (SELECT t, min(doc_id) AS low FROM docs GROUP BY t
        ), marks AS (
            SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
            FROM labels GROUP BY doc_id
        ), words AS (
            SELECT d.doc_id, part, d.t, regexp_extract_all(d.t, '[^\x20\x09-\x0D]+') AS w,
                coalesce(d.doc_id > f.low, false) AS e,
                coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic
            FROM docs d JOIN firsts f ON f.t = d.t LEFT JOIN marks m ON m.doc_id = d.doc_id
        ), failed AS (
            SELECT part, good, toxic,
                CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
                || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
                || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                || CASE WHEN e THEN 'E' ELSE '' END AS f
            FROM words
        ), counts AS (
            SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM failed GROUP BY part, f
        ), orders AS (
            SELECT '' AS o
            UNION ALL SELECT o || x FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS u(x) WHERE NOT contains(o, x)
        ), steps AS (
            SELECT o, i::INT AS step, o[i] AS x, o[:i - 1] AS before
            FROM orders, unnest(range(1, 6)) AS u(i) WHERE length(o) = 5
        ), result AS (
            SELECT part, o AS filter_order, step, x,
                sum(CASE WHEN translate(f, before || x, '') = f THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN contains(f, x) AND translate(f, before, '') = f THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN contains(f, x) AND translate(f, before, '') <> f THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN f = x THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN contains(f, x) AND translate(f, before, '') = f THEN good ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN contains(f, x) AND translate(f, before, '') = f THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM counts, steps GROUP BY part, o, step, x
        )
        SELECT * EXCLUDE (x), sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM result
    """,
}

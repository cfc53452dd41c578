"""SQL (DuckDB dialect) for the registered queries, on the same tables."""

from docloom.functions.urls import SEED_EXCLUDES

CORPUS = """corpus AS (
  SELECT doc_id, 'https://example.org/doc/' || doc_id AS url, source, lang,
         coalesce(nullif(split_part(text, chr(10), 1), ''),
                  'https://example.org/doc/' || doc_id) AS title,
         text AS content, sha256(text) AS content_hash
  FROM documents)"""


def tokens_of(text):
    return (
        f"list_filter(regexp_split_to_array(strip_accents(lower({text})), "
        "'[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
    )


def tokens_cte(table="corpus"):
    cells = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS col, {tokens_of(name)} AS ts FROM {table}"
        for i, name in enumerate(("title", "content", "source", "url"))
    )
    return f"""cells AS ({cells}),
tok AS (SELECT doc_id, col, unnest(ts) AS term, unnest(generate_series(0, len(ts) - 1)) AS pos
        FROM cells WHERE len(ts) > 0),
dl AS (SELECT doc_id, sum(len(ts)) AS n_tokens FROM cells GROUP BY doc_id),
st AS (SELECT count(*) AS n_docs, sum(n_tokens) AS n_tokens,
              sum(n_tokens)::DOUBLE / count(*) AS avgdl FROM dl)"""


BASE = f"WITH {CORPUS}, {tokens_cte()}"

IDF = """CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) > 0
     THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END"""
PART = f"({IDF}) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl.n_tokens / avgdl))"


def inst(number, where, extra=""):
    return f"SELECT {number} AS p, doc_id, col, pos FROM tok WHERE {where} {extra}"


def ranked(instances, keep, df=None):
    """Score documents from an instance table (p, doc_id, col, pos).

    ``keep`` restricts the documents; ``df`` is another instance table for frequencies.
    """
    return f"""{BASE},
inst AS ({instances}),
hits AS (SELECT p, doc_id, count(*) AS f FROM inst GROUP BY p, doc_id),
seen AS ({df or "SELECT * FROM inst"}),
dfs AS (SELECT p, count(DISTINCT doc_id) AS df FROM seen GROUP BY p),
part AS (SELECT doc_id, p, {PART} AS s FROM hits JOIN dfs USING (p) JOIN dl USING (doc_id), st),
total AS (SELECT doc_id, count(*) AS met, round(-sum(s), 9) AS score FROM part GROUP BY doc_id)
SELECT doc_id, score FROM total WHERE {keep}"""


def union(*parts):
    return " UNION ALL ".join(parts)


def holding(*terms):
    inside = ", ".join(f"'{t}'" for t in terms)
    return f"doc_id IN (SELECT doc_id FROM tok WHERE term IN ({inside}))"


def without(*terms):
    inside = ", ".join(f"'{t}'" for t in terms)
    return f"doc_id NOT IN (SELECT doc_id FROM tok WHERE term IN ({inside}))"


PHRASE = (
    "SELECT 0 AS p, a.doc_id, a.col, a.pos FROM tok a JOIN tok b ON a.doc_id = b.doc_id "
    "AND a.col = b.col AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'"
)


def near(terms, n):
    """Instances for which some choice of the other words keeps max(start) - end <= n."""
    parts = []
    for i, term in enumerate(terms):
        others = [t for j, t in enumerate(terms) if j != i]
        names = [f"o{j}" for j in range(len(others))]
        tables = ", ".join(f"tok {name}" for name in names)
        same = " AND ".join(
            f"{name}.doc_id = x.doc_id AND {name}.col = x.col AND {name}.term = '{other}'"
            for name, other in zip(names, others)
        )
        starts = ["x.pos"] + [f"{name}.pos" for name in names]
        high, low = f"greatest({', '.join(starts)})", f"least({', '.join(starts)})"
        parts.append(
            f"SELECT {i} AS p, x.doc_id, x.col, x.pos FROM tok x WHERE x.term = '{term}' AND "
            f"EXISTS (SELECT 1 FROM {tables} WHERE {same} AND {high} - {low} - 1 <= {n})"
        )
    return union(*parts)


def words(*terms):
    return union(*(inst(i, f"term = '{t}'") for i, t in enumerate(terms)))


HTML_NOISE = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b[^>]*>|\z)"
    r"|<style\b.*?(?:</style\b[^>]*>|\z)|<noscript\b.*?(?:</noscript\b[^>]*>|\z)"
)
BARE = f"regexp_replace(html, '{HTML_NOISE}', '', 'g')"
ARTICLE = rf"regexp_extract({BARE}, '(?is)<article\b[^>]*>(.*?)(?:</article\b|\z)', 1)"


def unescape(text):
    """The references that occur in the tables, also where the semicolon is cut off."""
    for name, char in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("copy", "©"), ("middot", "·")):
        text = f"regexp_replace({text}, '&{name};?', '{char}', 'g')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


RAW_TITLE = rf"regexp_extract({BARE}, '(?is)<title\b[^>]*>(.*?)</title', 1)"
TITLE = rf"regexp_replace({unescape(RAW_TITLE)}, '^\s+|\s+$', '', 'g')"
NORMAL = r"regexp_replace(regexp_replace(url, '#.*$', ''), '\?$', '')"
HREFS = rf"""regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>', '', 'g'),
  '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1)"""
LINKS = f"""links AS (
  SELECT page_id, url, unnest(hs) AS raw, unnest(generate_series(0, len(hs) - 1)) AS pos
  FROM (SELECT page_id, url, {HREFS} AS hs FROM pages) WHERE len(hs) > 0),
hrefs AS (SELECT page_id, url, pos, {unescape("raw")} AS href FROM links)"""
ROOTED = "regexp_extract(url, '^(https?://[^/?#]*)', 1) || href"
TARGET = rf"regexp_replace(regexp_replace({ROOTED}, '#.*$', ''), '\?$', '')"
HOST = "lower(regexp_extract(url, '^https?://([^/?#]*)', 1))"


def below(domain, host="host"):
    return f"({host} = '{domain}' OR {host} LIKE '%.{domain}')"


def rule(name, number, domains, include=None, exclude=None):
    test = "(" + " OR ".join(below(d) for d in domains) + ")"
    if include:
        test += f" AND regexp_matches(url, '{include}')"
    if exclude:
        test += f" AND NOT regexp_matches(url, '{exclude}')"
    return f"SELECT *, '{name}' AS source, {number} AS source_ord FROM hosted WHERE {test}"


def assigned(table, columns):
    """(columns, source, source_ord) for the rules of the Spark catalog."""
    return f"""hosted AS (SELECT {columns}, {HOST} AS host FROM {table}),
pairs AS ({union(
        rule("net-en", 0, ["example.net"], "/en/"),
        rule("org", 1, ["example.org"], None, r"/fr/|\?"),
        rule("secure", 2, ["example.com", "example.net"], "^https://"),
        rule("fr", 3, ["example.org", "example.com"], "/fr/", "ref="),
        rule("blog", 4, ["blog.example.com", "blog.example.org"]),
    )})"""


CONTENT_TOKENS = "array_to_string({}, ' ')".format(
    tokens_of(unescape(f"regexp_replace({ARTICLE}, '<[^>]*>|</?[a-zA-Z][^<>]*$', ' ', 'g')"))
)

SINGLE_BATCH = f"""{CORPUS},
batch AS (
  SELECT CASE WHEN source = 'src7' THEN url || '/new' ELSE url END AS url, source, doc_id AS seq,
         title,
         CASE WHEN lang = 'fr' THEN content || ' revised' ELSE content END AS content
  FROM corpus),
flagged AS (
  SELECT b.*, sha256(b.content) AS h, c.doc_id AS old_id,
         CASE WHEN c.doc_id IS NULL THEN 'inserted'
              WHEN c.content_hash = sha256(b.content) THEN 'skipped' ELSE 'updated' END AS change
  FROM batch b LEFT JOIN corpus c USING (url)),
changed AS (
  SELECT coalesce(old_id, (SELECT max(doc_id) FROM corpus)
                  + row_number() OVER (PARTITION BY old_id IS NULL ORDER BY seq)) AS doc_id,
         url, source, title, content, h AS content_hash
  FROM flagged WHERE change <> 'skipped'),
merged AS (
  SELECT doc_id, url, source, title, content, content_hash FROM corpus
  WHERE url NOT IN (SELECT url FROM changed)
  UNION ALL SELECT * FROM changed)"""

VERSIONS = """batch AS (
  SELECT 'https://example.org/' || source AS url, lang AS source,
         CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS source_ord,
         doc_id AS seq, sha256(text) AS h
  FROM documents),
stored AS (
  SELECT 'https://example.org/' || d.source AS url, d.doc_id, sha256(d.text) AS h
  FROM documents d JOIN (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source)
  USING (source, doc_id) WHERE d.lang IN ('en', 'fr')),
lagged AS (
  SELECT b.*, s.doc_id AS old_id,
         coalesce(lag(b.h) OVER (PARTITION BY url ORDER BY source_ord, seq), s.h) AS before
  FROM batch b LEFT JOIN stored s USING (url)),
flagged AS (
  SELECT *, CASE WHEN before IS NULL THEN 'inserted' WHEN before = h THEN 'skipped'
                 ELSE 'updated' END AS change FROM lagged),
final AS (
  SELECT url, source, seq, h, old_id,
         min(source_ord::BIGINT * 1000000000 + seq) OVER (PARTITION BY url) AS first,
         row_number() OVER (PARTITION BY url ORDER BY source_ord DESC, seq DESC) AS nth
  FROM flagged WHERE change <> 'skipped')"""

BATCH_TEXTS = f"""qtok AS (
  SELECT query_id, unnest(ts) AS term, unnest(generate_series(1, len(ts))) AS n
  FROM (SELECT item_id::VARCHAR AS query_id, {tokens_of("text")} AS ts FROM benchmark)),
qn AS (SELECT query_id, count(*) AS n_terms FROM qtok GROUP BY query_id),
hits AS (SELECT term, doc_id, count(*) AS f FROM tok
         WHERE term IN (SELECT term FROM qtok) GROUP BY term, doc_id),
dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scored AS (
  SELECT query_id, doc_id, count(*) AS met, -sum({PART}) AS s
  FROM qtok JOIN hits USING (term) JOIN dfs USING (term) JOIN dl USING (doc_id), st
  GROUP BY query_id, doc_id)"""


def ranking(where, k, source="scored"):
    limit = f" WHERE rank <= {k}" if k else ""
    return f"""SELECT query_id, rank, doc_id, round(s, 9) AS score FROM (
  SELECT query_id, doc_id, s,
         row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12), doc_id) AS rank
  FROM {source} {where}){limit}"""


TWO_WORDS = f"""hits AS (SELECT term, doc_id, count(*) AS f FROM tok GROUP BY term, doc_id),
dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term)"""


def word_scores(query_id, *terms):
    inside = ", ".join(f"'{t}'" for t in terms)
    return f"""SELECT {query_id} AS query_id, doc_id, -sum({PART}) AS s
FROM hits JOIN dfs USING (term) JOIN dl USING (doc_id), st WHERE term IN ({inside})
GROUP BY doc_id HAVING count(*) = {len(terms)}"""


def snippets(found, instances):
    """Extracts for ``found`` (query_id, doc_id) and their instances in the content, (query_id,
    doc_id, p, pos, size), as the table snippets. The instances must not overlap."""
    token = r"[\p{L}\p{N}]+"
    return rf"""found AS ({found}), spots AS ({instances}),
pieces AS (SELECT doc_id, regexp_extract_all(content, '{token}') AS ws,
                  regexp_split_to_array(content, '{token}') AS gs
           FROM corpus WHERE doc_id IN (SELECT doc_id FROM found)),
numbers AS (SELECT doc_id, gs, unnest(generate_series(0, len(ws) - 1)) AS opening FROM pieces
            WHERE len(ws) > 0),
sentences AS (SELECT doc_id, opening FROM numbers
              WHERE opening = 0 OR regexp_matches(gs[opening + 1], '[.:][ \t\n\r]+$')),
opened AS (SELECT a.query_id, a.doc_id, a.pos, s.opening
           FROM spots a ASOF JOIN sentences s ON a.doc_id = s.doc_id AND a.pos >= s.opening),
candidates AS (
  SELECT DISTINCT query_id, doc_id, pos AS first, 0 AS bonus, 2 * pos AS ord FROM spots
  UNION ALL
  SELECT DISTINCT query_id, doc_id, opening, CASE WHEN opening = 0 THEN 120 ELSE 100 END, 2 * pos + 1
  FROM opened JOIN pieces USING (doc_id) WHERE opening < pos AND len(ws) > 12),
weighed AS (
  SELECT c.query_id, c.doc_id, c.first, c.ord, max(a.pos + a.size) AS stop,
         any_value(c.bonus) + 999 * count(DISTINCT a.p) + count(*) AS weight
  FROM candidates c JOIN spots a ON a.query_id = c.query_id AND a.doc_id = c.doc_id
       AND a.pos BETWEEN c.first AND c.first + 11
  GROUP BY c.query_id, c.doc_id, c.first, c.ord),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY weight DESC, ord) AS nth
         FROM weighed),
placed AS (
  SELECT f.query_id, f.doc_id, ws, gs, len(ws) AS n,
         CASE WHEN b.first IS NULL THEN 0 WHEN ord % 2 = 1 THEN b.first
              ELSE greatest(0, least(b.first - (12 - (stop - b.first)) // 2, len(ws) - 12)) END AS start
  FROM found f JOIN pieces p USING (doc_id)
       LEFT JOIN best b ON b.query_id = f.query_id AND b.doc_id = f.doc_id AND nth = 1),
bounds AS (SELECT *, least(start + 12, n) - 1 AS stop FROM placed),
marks AS (SELECT query_id, doc_id, list(pos) AS opens, list(least(pos + size - 1, stop)) AS closes
          FROM spots JOIN bounds USING (query_id, doc_id) WHERE pos BETWEEN start AND stop
          GROUP BY query_id, doc_id),
snippets AS (
  SELECT query_id, doc_id, CASE WHEN n = 0 THEN gs[1] ELSE
    array_to_string(list_transform(generate_series(start, stop), lambda i:
      CASE WHEN i > start OR start = 0 THEN gs[i + 1] ELSE '...' END
      || CASE WHEN list_contains(opens, i) THEN '[' ELSE '' END || ws[i + 1]
      || CASE WHEN list_contains(closes, i) THEN ']' ELSE '' END), '')
    || CASE WHEN stop >= n - 1 THEN gs[n + 1] ELSE '...' END END AS snippet
  FROM bounds LEFT JOIN marks USING (query_id, doc_id))"""


REFRESHED = f"""admitted AS (
  SELECT page_id, {NORMAL} AS url, {TITLE} AS title, {CONTENT_TOKENS} AS tokens FROM pages),
{assigned("admitted", "page_id, url, title, tokens")}"""

# All versions of a page in the tables have the same content, so the first one stays.
STORED = f"""WITH {REFRESHED},
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_ord, page_id) AS nth FROM pairs)
SELECT row_number() OVER (ORDER BY source_ord, page_id) AS doc_id, url, source,
       coalesce(nullif(title, ''), url) AS title, tokens
FROM firsts WHERE nth = 1"""

RULE_NAMES = "(VALUES ('net-en'), ('org'), ('secure'), ('fr'), ('blog')) AS names(source)"

ORACLE = {
    "scan_pages": "SELECT page_id, url, length(html) AS n_chars FROM pages",
    "stored_corpus": f"WITH {SINGLE_BATCH} SELECT doc_id, url, source, content_hash FROM merged",
    "get_document": f"""WITH {SINGLE_BATCH} SELECT doc_id, url, source, content_hash FROM merged
WHERE doc_id = 7 UNION ALL
SELECT doc_id, url, source, content_hash FROM merged WHERE url = 'https://example.org/doc/12'""",
    "read_keys": f"""WITH {SINGLE_BATCH} SELECT doc_id, url, source, content_hash FROM merged
WHERE url IN (SELECT 'https://example.org/doc/' || (doc_id * 2) FROM labels)""",
    "results_json": "SELECT '{\"source\":\"' || source || '\",\"count\":' || count(*) || '}' AS json "
    "FROM documents GROUP BY source",
    "list_urls": "SELECT 'https://example.org/doc/' || doc_id AS url FROM documents",
    "seed_rules": f"""SELECT 'p' || page_id AS name, url AS start_url, domain,
  '^https://' || domain || base || '/' AS include, '{" ".join(SEED_EXCLUDES)}' AS exclude,
  1000 AS max_pages,
  '^' || scheme || '://' || regexp_replace(domain || base, '([.])', '\\\\\\1', 'g') || '(/|$)'
    AS repaired
FROM (SELECT page_id, url, regexp_extract(url, '^(https?)://', 1) AS scheme,
             regexp_extract(url, '^https?://([^/?#]*)', 1) AS domain,
             rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') AS base FROM pages)""",
    "normalize_url": f"SELECT url, {NORMAL} AS normalized FROM pages",
    "resolve_link": f"WITH {LINKS} SELECT page_id, pos, href, {ROOTED} AS target FROM hrefs",
    "host_allowed": f"""SELECT page_id, {below("example.org")} OR {below("m.example.net")} AS allowed
FROM (SELECT page_id, {HOST} AS host FROM pages)""",
    "assign_sources": f"WITH {assigned('pages', 'page_id, url')} SELECT page_id, source FROM pairs",
    "assign_seeds": """WITH hosts AS (
  SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS source FROM pages)
SELECT page_id, source FROM pages JOIN hosts ON starts_with(url, 'https://' || source || '/en/')""",
    "unescape": """SELECT page_id, chr((page_id + 161)::INT) || chr((page_id + 161)::INT) || '&'
  || chr((page_id + 161)::INT) || CASE WHEN page_id + 161 > 65535 THEN '' ELSE chr(65533) END
  || '©' || ' &bogus;' || chr(65533) || '€' AS text FROM pages""",
    "admit_fetch": "SELECT page_id FROM pages WHERE html LIKE '%</html>' AND url NOT LIKE '%?%'",
    "page_title": f"SELECT page_id, {TITLE} AS title FROM pages",
    "title_or_url": f"SELECT page_id, CASE WHEN url LIKE 'https%' OR {TITLE} = '' THEN url "
    f"ELSE {TITLE} END AS title FROM pages",
    "strip_boilerplate": f"SELECT page_id, {BARE} AS html FROM pages",
    "article_text": f"SELECT page_id, {ARTICLE} AS article FROM pages",
    "normalize_text": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'),
  '^\s+|\s+$', '', 'g') AS text FROM documents""",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "extract_links": f"WITH {LINKS} SELECT page_id, pos, href FROM hrefs WHERE href <> ''",
    "link_edges": f"WITH {LINKS} SELECT {NORMAL} AS src_url, pos, href, {TARGET} AS target_url "
    "FROM hrefs WHERE href <> ''",
    "pending_links": f"""WITH {LINKS}, targets AS (
  SELECT DISTINCT {TARGET} AS url FROM hrefs WHERE href <> ''),
fresh AS (SELECT url FROM targets WHERE url NOT IN (SELECT {NORMAL} FROM pages)),
{assigned("fresh", "url")} SELECT source, url FROM pairs""",
    "drop_seen": f"""WITH {LINKS} SELECT page_id, pos, href FROM hrefs WHERE href NOT IN (
  SELECT '/' || unnest(string_split(text, ' ')) FROM documents)""",
    "extract_pages": f"SELECT page_id, coalesce(nullif({TITLE}, ''), url) AS title, "
    f"{CONTENT_TOKENS} AS tokens FROM pages",
    "keep_nonempty": f"SELECT page_id FROM pages WHERE url NOT LIKE '%/fr/%' AND {ARTICLE} <> ''",
    "read_by_id": f"""WITH {CORPUS} SELECT l.doc_id * 2 AS doc_id, c.url, c.title, c.content_hash
FROM labels l LEFT JOIN corpus c ON c.doc_id = l.doc_id * 2""",
    "read_by_url": f"""WITH {CORPUS}
SELECT 'https://example.org/doc/' || (l.doc_id * 2) AS url, c.doc_id, c.content_hash
FROM labels l LEFT JOIN corpus c ON c.doc_id = l.doc_id * 2""",
    "count_by_source": "SELECT source, count(*) AS count FROM documents GROUP BY source",
    "corpus_count": "SELECT count(*) AS documents FROM documents",
    "corpus_report": "SELECT sum(count(*)) OVER ()::BIGINT AS documents, source, count(*) AS count "
    "FROM documents GROUP BY source",
    "classify_changes": f"WITH {SINGLE_BATCH} SELECT url, change, old_id FROM flagged",
    "flag_versions": f"WITH {VERSIONS} SELECT url, source, seq, change FROM flagged",
    "fold_versions": f"WITH {VERSIONS} SELECT url, source, seq, h AS content_hash, old_id "
    "FROM final WHERE nth = 1",
    "assign_ids": f"""WITH {VERSIONS} SELECT url, coalesce(old_id, (SELECT max(doc_id) FROM stored)
  + row_number() OVER (PARTITION BY old_id IS NULL ORDER BY first)) AS doc_id
FROM final WHERE nth = 1""",
    "index_summary": f"""WITH {VERSIONS}, names AS (
  SELECT lang AS source FROM documents UNION SELECT source FROM documents)
SELECT source, count(f.url) AS processed, count(*) FILTER (f.change <> 'skipped') AS updated,
       count(*) FILTER (f.change = 'skipped') AS skipped
FROM names LEFT JOIN flagged f USING (source) GROUP BY source""",
    "merge_corpus": f"WITH {SINGLE_BATCH} SELECT doc_id, url, source, content_hash FROM merged",
    "merge_index": f"""WITH {SINGLE_BATCH}, {tokens_cte("merged")}
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY term""",
    "rebuild_index": f"""{BASE} SELECT (SELECT count(DISTINCT term) FROM tok) AS n_terms, n_docs,
  n_tokens::BIGINT AS n_tokens FROM st""",
    "tokenize": f"""SELECT doc_id, unnest(ts) AS term, unnest(generate_series(0, len(ts) - 1)) AS pos
FROM (SELECT doc_id, {tokens_of("text")} AS ts FROM documents) WHERE len(ts) > 0""",
    "postings": f"""{BASE} SELECT term, doc_id, col, count(*) AS tf,
  string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions, any_value(n_tokens)::INT AS n_tokens
FROM tok JOIN dl USING (doc_id) GROUP BY term, doc_id, col""",
    "term_stats": f"{BASE} SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term",
    "corpus_stats": f"{BASE} SELECT n_docs, n_tokens::BIGINT AS n_tokens, round(avgdl, 6) AS avgdl "
    "FROM st",
    "bm25_terms": ranked(words("the", "and"), "met = 2"),
    "bm25_repeated": ranked(words("the", "the", "de"), "met = 3"),
    "bm25_any": ranked(words("thtion", "des", "que"), "met > 0"),
    "bm25_not": ranked(words("the"), without("of", "src3")),
    "bm25_nested": ranked(
        words("the", "des", "of", "que"),
        f"{holding('the', 'des')} AND {holding('of', 'que')} AND {without('src2')}",
    ),
    "bm25_nested_parts": ranked(
        union(
            inst(0, f"term = 'the' AND {holding('src1')}"),
            inst(1, f"term = 'src1' AND {holding('the')}"),
            inst(2, f"term = 'de' AND {holding('src3')}"),
            inst(3, f"term = 'src3' AND {holding('de')}"),
            f"SELECT 4 AS p, doc_id, col, pos FROM ({PHRASE}) WHERE {holding('src5')}",
            inst(5, "term = 'src5' AND doc_id IN (SELECT doc_id FROM (" + PHRASE + "))"),
        ),
        "met > 0",
        f"{words('the', 'src1', 'de', 'src3')} UNION ALL SELECT 4, doc_id, col, pos FROM ({PHRASE}) "
        f"UNION ALL {inst(5, "term = 'src5'")}",
    ),
    "bm25_phrase": ranked(PHRASE, without("src1")),
    "bm25_prefix": ranked(
        union(inst(0, "term LIKE 'men%'"), inst(1, "term LIKE 'qu%'")), "met = 2"
    ),
    "bm25_column": ranked(
        union(inst(0, "term = 'the' AND col = 0"), inst(1, "term = 'of' AND col IN (1, 2)")),
        "met = 2",
    ),
    "bm25_initial": ranked(inst(0, "term = 'the' AND pos = 0"), "met = 1"),
    "bm25_near": ranked(near(["the", "of"], 2), "met = 2", words("the", "of")),
    "bm25_near_three": ranked(
        near(["the", "of", "and"], 3), "met = 3", words("the", "of", "and")
    ),
    "match_sets": f"""{BASE} SELECT DISTINCT doc_id FROM tok WHERE term IN ('the', 'des')
AND doc_id IN (SELECT doc_id FROM tok WHERE term IN ('of', 'que')) AND {without("src2")}""",
    "search_batch": f"{BASE}, {BATCH_TEXTS} "
    + ranking("JOIN qn USING (query_id) WHERE met = n_terms", 10),
    "search_batch_any": f"{BASE}, {BATCH_TEXTS} " + ranking("", 10),
    "rank_all": f"""{BASE}, {TWO_WORDS},
scored AS ({word_scores("'a'", "the")} UNION ALL {word_scores("'b'", "de", "la")}) """
    + ranking("", None),
    "search_source": f"""{BASE}, {TWO_WORDS}, all_scored AS ({word_scores("'x'", "the", "and")}),
scored AS (SELECT c.source AS query_id, a.doc_id, a.s FROM all_scored a JOIN corpus c USING (doc_id)) """
    + ranking("", 3),
    "search_hits": f"""{BASE}, {TWO_WORDS}, scored AS ({word_scores("'q'", "the", "and")}),
best AS ({ranking("", 10)})
SELECT query_id, rank, doc_id AS id, title, url, source, score FROM best JOIN corpus USING (doc_id)""",
    "search_text": f"""{BASE}, {TWO_WORDS}, scored AS ({word_scores("'q'", "the", "and")}),
ranks AS ({ranking("", 10)}),
{snippets("SELECT query_id, doc_id FROM ranks",
          "SELECT query_id, doc_id, term AS p, pos, 1 AS size FROM tok JOIN ranks USING (doc_id) "
          "WHERE col = 1 AND term IN ('the', 'and')")}
SELECT rank, doc_id AS id, title, url, source, score, snippet
FROM ranks JOIN corpus USING (doc_id) JOIN snippets USING (doc_id)""",
    "snippet": f"""{BASE}, phrases AS ({PHRASE}), held AS (
  SELECT 'a' AS query_id, doc_id, col, 'of the' AS p, pos, 2 AS size FROM phrases
  UNION ALL SELECT 'b', doc_id, col, term, pos, 1 FROM tok WHERE term = 'que'),
{snippets("SELECT DISTINCT query_id, doc_id FROM held",
          "SELECT query_id, doc_id, p, pos, size FROM held WHERE col = 1")}
SELECT query_id, doc_id AS id, snippet FROM snippets""",
    "page_budget": """SELECT source, url, nth + 1 AS crawl_ord FROM (
  SELECT source, 'https://example.org/' || doc_id AS url,
         row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS nth,
         count(*) OVER (PARTITION BY source) // 4 AS max_pages FROM documents)
WHERE nth + 1 <= max_pages""",
    "dedupe_first": """SELECT source, 'https://example.org/' || lang AS url, n_chars AS parent_ord,
  doc_id AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS nth
  FROM documents) WHERE nth = 1""",
    "crawl_frontier": f"""WITH {LINKS}, targets AS (
  SELECT page_id, {TARGET} AS target, min(pos) AS pos FROM hrefs WHERE href <> ''
  GROUP BY page_id, target),
captures AS (SELECT {NORMAL} AS start, min(page_id) AS page_id FROM pages GROUP BY start),
owners AS (SELECT 'p' || page_id AS source, {NORMAL} AS start FROM pages),
found AS (
  SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY pos) AS nth
  FROM owners JOIN captures USING (start) JOIN targets USING (page_id) WHERE target <> start)
SELECT source, start AS url, 1 AS crawl_ord, 0 AS depth FROM owners
UNION ALL
SELECT source, target, nth + 1, 1 FROM found WHERE nth <= 3""",
    "refresh": STORED,
    "refresh_order": f"""SELECT DISTINCT {NORMAL} AS url, 'zeta' AS source
FROM (SELECT url, {HOST} AS host FROM pages) WHERE {below("example.org")} OR {below("example.com")} OR {below("example.net")}""",
    "refresh_summary": f"""WITH {REFRESHED},
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_ord, page_id) AS nth FROM pairs)
SELECT names.source, count(url) AS processed, count(*) FILTER (nth = 1) AS updated,
       count(*) FILTER (nth > 1) AS skipped
FROM {RULE_NAMES} LEFT JOIN firsts USING (source) GROUP BY names.source""",
    "refresh_captures": f"""WITH {REFRESHED}
SELECT DISTINCT url, 'captured again' AS title, 1 AS rows, 1 AS ids FROM pairs""",
    "refresh_admitted": f"""WITH {REFRESHED}
SELECT DISTINCT p.url FROM pairs p JOIN pages q USING (page_id)
WHERE q.html LIKE '%</html>' AND q.url NOT LIKE '%?%'""",
    "refresh_crawl": f"""SELECT url, title FROM (
  SELECT {NORMAL} AS url, CASE WHEN {TITLE} = '' THEN {NORMAL} ELSE {TITLE} END AS title,
         row_number() OVER (PARTITION BY {NORMAL} ORDER BY page_id) AS nth FROM pages)
WHERE nth = 1""",
    "stream_refresh": STORED,
}

"""The catalogue's queries in SQL, written apart from the plans: scores term by term, not in their short form."""

from __future__ import annotations

from ..functions.detect import BRANDS, COMPONENT_WORDS, LAPTOP_WORDS, SYSTEMS, URL_NAMESPACE
from ..functions.text import stop_words
from .catalogue import QUERY, SPIDERS, STRINGS, TEXTS


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(texts: tuple[str, ...]) -> str:
    return ", ".join(f"({-i - 1}, {_quoted(s)})" for i, s in enumerate(texts))


def _tokens(expression: str) -> str:
    """A list of the raw tokens of a string."""
    url, mark = r"https?://[^\s\p{Z}]+|www\.[^\s\p{Z}]+", r"[^\p{L}\p{N}_\s]"
    return rf"string_split_regex(regexp_replace(regexp_replace(lower({expression}), '{url}', ' ', 'g'), '{mark}', ' ', 'g'), '\s+')"


def _kept() -> str:
    return "length(term) > 1 AND term NOT IN (" + ", ".join(map(_quoted, stop_words())) + ")"


def _index() -> str:
    return f"""
tok AS (SELECT doc_id, term FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest({_tokens("' ' || coalesce(text, '')")}) AS term FROM documents) WHERE {_kept()}),
post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
info AS (SELECT doc_id, count(*) AS length FROM tok GROUP BY 1),
coll AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df, sum(tf) / (SELECT CAST(sum(length) AS DOUBLE) FROM info) AS p FROM post GROUP BY term)"""


def _bench() -> str:
    return f"""
btok AS (SELECT query_id, term FROM (SELECT item_id AS query_id, unnest({_tokens("coalesce(text, '')")}) AS term FROM benchmark) WHERE {_kept()}),
bq AS (SELECT query_id, term, count(*) / CAST(sum(count(*)) OVER (PARTITION BY query_id) AS DOUBLE) AS weight FROM btok GROUP BY 1, 2)"""


def _typed() -> str:
    return f"""
tq AS (SELECT CAST(1 AS BIGINT) AS query_id, term, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS weight FROM (SELECT unnest(string_split({_quoted(QUERY)}, ' ')) AS term) GROUP BY term)"""


def _hits(name: str, q: str, k: int, where: str = "TRUE") -> str:
    return f"""
{name}_score AS (
  SELECT c.query_id, c.doc_id, sum(q.weight * ln((coalesce(p.tf, 0) + 2000 * coalesce(l.p, 1e-9)) / (i.length + 2000))) AS score
  FROM (SELECT DISTINCT q.query_id, p.doc_id FROM {q} q JOIN post p USING (term)) c
  JOIN {q} q ON q.query_id = c.query_id JOIN info i ON i.doc_id = c.doc_id JOIN documents d ON CAST(d.doc_id AS VARCHAR) = c.doc_id
  LEFT JOIN post p ON p.doc_id = c.doc_id AND p.term = q.term LEFT JOIN coll l ON l.term = q.term
  WHERE {where} GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS INT) AS rank, doc_id, round(score, 6) AS score FROM {name}_score) WHERE rank <= {k})"""


def _rm1(name: str, hits: str) -> str:
    return f"""
{name}_odds AS (SELECT query_id, doc_id, exp(score - max(score) OVER (PARTITION BY query_id)) AS odds FROM {hits}),
{name}_post AS (SELECT query_id, doc_id, odds / sum(odds) OVER (PARTITION BY query_id) AS posterior FROM {name}_odds),
{name}_mass AS (SELECT query_id, term, sum(CAST(tf AS DOUBLE) / length * posterior) AS mass FROM {name}_post JOIN info USING (doc_id) JOIN post USING (doc_id) GROUP BY 1, 2),
{name} AS (SELECT query_id, term, mass / sum(mass) OVER (PARTITION BY query_id) AS weight FROM {name}_mass)"""


def _rm3(name: str, q: str, rm1: str) -> str:
    return f"""
{name}_mix AS (SELECT query_id, term, 0.5 * coalesce(a.weight, 0) + 0.5 * coalesce(b.weight, 0) AS weight, a.weight AS own FROM {q} a FULL JOIN {rm1} b USING (query_id, term)),
{name}_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 12) DESC, term) AS place FROM {name}_mix WHERE query_id IN (SELECT query_id FROM {rm1})) WHERE place <= 10),
{name} AS (SELECT query_id, term, weight / sum(weight) OVER (PARTITION BY query_id) AS weight FROM {name}_best
  UNION ALL SELECT query_id, term, weight FROM {q} WHERE query_id NOT IN (SELECT query_id FROM {rm1}))"""


def _tfidf() -> str:
    return """
vocab AS (SELECT term, cf, df, ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM (SELECT * FROM coll ORDER BY cf DESC, term LIMIT 15000)),
vraw AS (SELECT doc_id, term, tf * idf AS w FROM post JOIN vocab USING (term)),
vec AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM vraw)"""


def _case(table: tuple[tuple[str, str], ...], text: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, {_quoted(k)}) THEN {_quoted(v)}" for k, v in table) + " END"


def _strings() -> str:
    """Cleaned query strings: trimmed, lower-cased, one blank for white space."""
    return rf"""
s AS (SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations UNION ALL SELECT * FROM (VALUES {_values(STRINGS)}) v(query_id, query)),
c AS (SELECT query_id, string_split(trim(lower(regexp_replace(coalesce(query, ''), '[\s\p{{Z}}\x{{85}}]+', ' ', 'g'))), ' ') AS words FROM s),
w AS (SELECT query_id, i, words[i] AS word, regexp_matches(words[i], '^[\p{{L}}\p{{N}}_]+:\S+$') AS f FROM (SELECT query_id, words, unnest(range(1, len(words) + 1)) AS i FROM c) WHERE words[i] <> '')"""


#: A page's date: of its time element, else of its metas.
_DATE = "CASE WHEN doc_id % 3 = 1 THEN '2023-12-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') WHEN doc_id % 3 = 2 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END"


def sql_map() -> dict[str, str]:
    index, bench, typed = _index(), _bench(), _typed()
    laptop, component = (" OR ".join(f"contains(text, {_quoted(w)})" for w in words) for words in (LAPTOP_WORDS, COMPONENT_WORDS))
    flagship_words = r"""
fw AS (SELECT query_id, term FROM (SELECT item_id AS query_id, unnest(string_split(trim(lower(regexp_replace(coalesce(text, ''), '[\s\p{Z}\x{85}]+', ' ', 'g'))), ' ')) AS term FROM benchmark) WHERE term <> '' AND NOT regexp_matches(term, '^[\p{L}\p{N}_]+:\S+$')),
fq AS (SELECT query_id, term, count(*) / CAST(sum(count(*)) OVER (PARTITION BY query_id) AS DOUBLE) AS weight FROM fw GROUP BY 1, 2)"""
    text_search = r"""
qraw AS (SELECT query_id, term, count(*) * any_value(idf) AS w FROM btok JOIN vocab USING (term) GROUP BY 1, 2),
qv AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS q FROM qraw)"""
    best = """
sc AS (SELECT query_id, doc_id, round(sum(w * q), 6) AS score FROM every JOIN qv USING (term) GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM sc) WHERE rank <= 10)"""
    rows = f"SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_values(TEXTS)}) v(doc_id, text)"
    queries = {
        "normalize_tokens": f"""
WITH raw AS (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_tokens("' ' || coalesce(text, '')")} AS toks FROM documents)),
t AS (SELECT doc_id, i, toks[i] AS term FROM raw)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos, term FROM t WHERE {_kept()}""",
        "postings_tf": f"WITH {index} SELECT doc_id, term, tf FROM post",
        "doc_info_length": f"WITH {index} SELECT i.doc_id, i.length, d.source, d.lang AS category FROM info i JOIN documents d ON CAST(d.doc_id AS VARCHAR) = i.doc_id",
        "index_stats": f"WITH {index} SELECT (SELECT count(*) FROM info) AS documents, count(*) AS vocabulary, CAST(sum(cf) AS BIGINT) AS tokens FROM coll",
        "collection_model": f"WITH {index} SELECT term, cf, df, p FROM coll",
        "ql_dirichlet_topk": f"WITH {index}, {typed}, {_hits('h', 'tq', 10)} SELECT * FROM h",
        "ql_dirichlet_category": f"WITH {index}, {typed}, {_hits('h', 'tq', 10, "d.lang = 'es'")} SELECT * FROM h",
        "ql_batch_topk": f"WITH {index}, {bench}, {_hits('h', 'bq', 10)} SELECT * FROM h",
        "query_parse_filters": rf"""
WITH {_strings()},
f AS (SELECT query_id, split_part(word, ':', 1) AS key, arg_max(substr(word, strpos(word, ':') + 1), i) AS value FROM w WHERE f GROUP BY 1, 2)
SELECT c.query_id, coalesce((SELECT string_agg(word, ' ' ORDER BY i) FROM w WHERE w.query_id = c.query_id AND NOT f), '') AS text,
       (SELECT count(*) FROM w WHERE w.query_id = c.query_id AND NOT f) AS n_tokens,
       coalesce((SELECT string_agg(key || '=' || value, ';' ORDER BY key || '=' || value) FROM f WHERE f.query_id = c.query_id), '') AS filters FROM c""",
        "query_weights": f"WITH {bench} SELECT query_id, term, round(weight, 6) AS weight FROM bq",
        "rm1_feedback": f"WITH {index}, {typed}, {_hits('h', 'tq', 5)}, {_rm1('r', 'h')} SELECT query_id, term, round(weight, 6) AS weight FROM r",
        "rm3_expand": f"WITH {index}, {bench}, {_hits('h', 'bq', 5)}, {_rm1('r', 'h')}, {_rm3('x', 'bq', 'r')} SELECT query_id, term, round(weight, 6) AS weight FROM x",
        "flagship_ql_rm3": f"""WITH {index}, {flagship_words}, {_hits("h", "fq", 5)}, {_rm1("r", "h")}, {_rm3("x", "fq", "r")}, {_hits("g", "x", 5)}
SELECT g.*, d.source, d.lang AS category FROM g JOIN documents d ON CAST(d.doc_id AS VARCHAR) = g.doc_id""",
        "tfidf_vocab": f"WITH {index}, {_tfidf()} SELECT term, cf, df, round(idf, 6) AS idf FROM vocab",
        "tfidf_vectors": f"WITH {index}, {_tfidf()} SELECT doc_id, term, round(w, 6) AS w FROM vec",
        "tfidf_cosine_topk": f"""WITH {index}, {bench}, {_tfidf()},
qraw AS (SELECT query_id, term, count(*) * any_value(idf) AS w FROM btok JOIN vocab USING (term) GROUP BY 1, 2),
qv AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS q FROM qraw),
sc AS (SELECT query_id, doc_id, round(sum(w * q), 6) AS score FROM vec JOIN qv USING (term) GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM sc) WHERE rank <= 10""",
        "dense_cosine_topk": """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sc AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e q, e WHERE q.vec_id % 100 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM sc) WHERE rank <= 10""",
        "index_roundtrip": f"WITH {index} SELECT term, cf, df, p FROM coll",
        "vector_text_search": f"""WITH {index}, {bench}, {_tfidf()}, {text_search}, every AS (SELECT * FROM vec), {best}
SELECT top.*, d.source, d.lang AS category FROM top JOIN documents d ON CAST(d.doc_id AS VARCHAR) = top.doc_id""",
        "vector_add_document": f"""WITH {index}, {bench}, {_tfidf()}, {text_search},
every AS (SELECT * FROM vec UNION ALL SELECT CAST(-query_id - 1 AS VARCHAR), term, q FROM qv), {best}
SELECT top.*, coalesce(d.source, 'added') AS source, coalesce(d.lang, 'xx') AS category FROM top LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = top.doc_id""",
        "vector_hits": """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sc AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, e.label, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e q, e WHERE q.vec_id % 100 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id,
CASE WHEN label > 4 THEN 'u' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS url, CAST(label AS VARCHAR) AS category FROM sc) WHERE rank <= 10""",
        "first_filled_text": "SELECT conv_id, turn, coalesce(nullif(CASE WHEN role <> 'user' THEN role END, ''), nullif(text, ''), role) AS first FROM conversations",
        "seen_url_sessions": """
SELECT min(page_id) AS page_id, url FROM pages WHERE url <> '' AND url NOT LIKE 'http://%' GROUP BY url
UNION ALL SELECT page_id, url FROM pages WHERE url IS NULL OR url = ''""",
        "stream_seen_sessions": """
SELECT user_id || '/' || event_type AS url, CASE WHEN min(ts) < TIMESTAMP '2024-01-02' THEN 1 ELSE 2 END AS session FROM events GROUP BY 1""",
        "stream_sketches": "SELECT CAST(i AS INT) AS generation, TRUE AS close FROM range(4) t(i) WHERE (SELECT count(*) FROM documents) > 0",
        "stream_progress": "SELECT count(*) AS rows_in, 'done' AS ended FROM events",
        "store_lookup": """
WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS content, source, lang AS category FROM documents)
SELECT 'one' AS how, id, content, source, category FROM d WHERE doc_id = 7 UNION ALL SELECT 'category', id, content, source, category FROM d WHERE category = 'fr'
UNION ALL SELECT 'many', id, content, source, category FROM d WHERE doc_id IN (SELECT item_id FROM benchmark)""",
        "stream_crawl": "SELECT DISTINCT user_id || '/' || event_type AS url, '2023-11-14T22:13:20' AS scraped_at FROM events",
        "crawl_traverse": r"""
WITH RECURSIVE walk AS (
  SELECT page_id, 0 AS depth FROM pages WHERE page_id BETWEEN 1 AND 9
  UNION SELECT p.page_id, depth + 1 FROM walk w JOIN pages p ON p.page_id IN (2 * w.page_id, 2 * w.page_id + 1)),
reached AS (SELECT page_id, min(depth) AS depth FROM walk GROUP BY 1)
SELECT 'https://site.example/d' || (page_id % 7) || '/p' || page_id AS url, CAST(depth AS INT) AS depth,
  nullif(trim(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<h1[^>]*>([^<]*)', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&amp;', '&')), '') AS title
FROM reached JOIN pages USING (page_id)""",
        "paced_pages": """
SELECT url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)) AS host, CAST(length(min(html)) AS INT) AS n_chars
FROM pages WHERE url <> '' AND html IS NOT NULL GROUP BY url""",
        "vector_upsert": """
SELECT coalesce(n.doc_id, o.vec_id) AS doc_id, coalesce(n.label, o.label) AS label, CAST(coalesce(n.first, o.embedding[1]) AS DOUBLE) AS first
FROM embeddings o FULL JOIN (SELECT vec_id + 100 AS doc_id, label + 10 AS label, embedding[1] AS first FROM embeddings) n ON n.doc_id = o.vec_id""",
        "vector_graph_recall": "SELECT vec_id AS query_id, state, TRUE AS enough FROM embeddings, (VALUES ('built'), ('upserted')) s(state) WHERE vec_id % 100 = 0",
        "vector_stats": "SELECT count(*) AS vectors FROM embeddings",
        "docs_by_category": "SELECT lang AS category, count(*) AS documents FROM documents GROUP BY 1",
        "doc_lookup": "SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS content, source, lang AS category FROM documents WHERE doc_id = 7",
        "docs_in_category": "SELECT CAST(doc_id AS VARCHAR) AS id, source FROM documents WHERE lang = 'fr'",
        "dedupe_last_wins": "SELECT max(doc_id) AS doc_id FROM documents GROUP BY text",
        "seen_url_antijoin": "SELECT page_id, url FROM pages WHERE url IS NULL OR url = '' OR url NOT IN (SELECT url FROM pages WHERE url LIKE 'http://%')",
        "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
        "stream_index": f"WITH {index} SELECT (SELECT count(*) FROM info) AS documents, count(*) AS vocabulary, CAST(sum(cf) AS BIGINT) AS tokens FROM coll",
        "html_title": r"SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>([^<]*)', 1)), '') AS title FROM pages",
        "article_title": r"""
SELECT page_id, nullif(trim(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<h1[^>]*>([^<]*)', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&amp;', '&')), '') AS title FROM pages""",
        "html_links": """
SELECT page_id, CAST(i - 1 AS INT) AS pos, links[i] AS href FROM (SELECT page_id, links, unnest(range(1, len(links) + 1)) AS i
FROM (SELECT page_id, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS links FROM pages))""",
        "detect_brand_os": f"SELECT doc_id, {_case(BRANDS, 'lower(text)')} AS brand, {_case(SYSTEMS, 'lower(text)')} AS os FROM ({rows})",
        "pc_subcategories": f"SELECT CASE WHEN {laptop} THEN 'laptop' WHEN {component} THEN 'component' ELSE 'pc' END AS subcategory, count(*) AS n FROM ({rows}) GROUP BY 1",
        "sink_route": f"""
WITH v AS (SELECT DISTINCT source || '_' || CASE doc_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'pc' ELSE 'blog' END AS spider FROM documents WHERE source IS NOT NULL
  UNION ALL SELECT * FROM (VALUES {", ".join(f"({_quoted(s)})" for s in SPIDERS)}) s(spider))
SELECT spider, CASE WHEN contains(spider, 'mobile') OR spider = 'apple_newsroom' THEN 'mobile' WHEN contains(spider, 'pc') THEN 'pc' ELSE 'general' END AS category FROM v""",
        "jsonl_roundtrip": """
SELECT 'https://example.org/' || doc_id AS id, '' AS title, CASE WHEN doc_id % 2 = 0 THEN 'again ' || text ELSE coalesce(text, '') END AS content, source,
       CASE WHEN doc_id % 2 = 0 THEN 'pc' ELSE 'mobile' END AS category, lang AS subcategory, lang AS tags FROM documents""",
        "uuid5_id": f"""
WITH h AS (SELECT doc_id, sha1(unhex('{URL_NAMESPACE}') || encode(coalesce(text, ''))) AS x FROM documents)
SELECT doc_id, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab', (CAST('0x' || substr(x, 17, 1) AS INT) % 4) + 1, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS id FROM h""",
        "tag_union": """
SELECT doc_id, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags FROM (
  SELECT DISTINCT doc_id, trim(tag) AS tag FROM (SELECT doc_id, unnest([source, lang, 't' || (doc_id % 4)]) AS tag FROM documents) WHERE trim(tag) <> '') GROUP BY doc_id""",
        "postings_custom_normalizer": r"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id = 7 THEN 'Nuevo texto NUEVO de prueba' ELSE coalesce(text, '') END AS text FROM documents)
SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(string_split_regex(lower(' ' || text), '[^a-z]+')) AS term FROM d) WHERE length(term) > 3 GROUP BY ALL""",
        "news_articles": rf"""
SELECT doc_id, 'Nota ' || doc_id AS title, CASE WHEN doc_id % 2 = 1 THEN source ELSE 'Ana ' || source END AS author, {_DATE} AS date,
  'uno ' || coalesce(text, '') || ' dos tres cuatro' AS content,
  (SELECT string_agg(tag, '|' ORDER BY tag) FROM (SELECT DISTINCT trim(unnest([lang, 'móviles', 'iphone', source])) AS tag)) AS tags, 's' || (doc_id % 5) AS section, '/i/' || doc_id AS image
FROM documents WHERE doc_id IS NOT NULL""",
        "news_items": f"""
WITH t AS (SELECT doc_id, 'Nota ' || doc_id || ' uno ' || coalesce(text, '') || ' dos tres cuatro' AS text, {_DATE} AS date, lang, source FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT *, lower(text || ' ' || list_aggregate(list_sort(list_distinct([lang, 'móviles', 'iphone', source])), 'string_agg', ' ')) AS every FROM t)
SELECT 'https://n.example/' || doc_id AS url, coalesce(date, '2023-11-14T22:13:20Z') AS date, 'fixture' AS source, '2023-11-14T22:13:20' AS scraped_at, {_case(BRANDS, "every")} AS brand, {_case(SYSTEMS, "every")} AS os,
  CASE WHEN {laptop} THEN 'laptop' WHEN {component} THEN 'component' ELSE 'pc' END AS category, 's' || (doc_id % 5) AS section, 'magazine' AS blog_type, 0 AS n_specs, CAST(NULL AS VARCHAR) AS price FROM s""",
    }
    same = {"ql_saved_topk": "ql_batch_topk", "ql_blockmax_topk": "ql_batch_topk", "rm1_saved": "rm1_feedback", "flagship_saved": "flagship_ql_rm3", "saved_stats": "index_stats", "tfidf_ml": "tfidf_vectors", "sql_extract_links": "html_links", "sql_normalize_tokens": "normalize_tokens"}
    return queries | {name: queries[other] for name, other in same.items()}

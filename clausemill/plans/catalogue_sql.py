"""DuckDB SQL with the same rows as the catalogue's queries, written independently of the operators."""

from __future__ import annotations

from ..operators import context as C

HEAD = r"'^\s*(\d+(?:\.\d+){1,3}(?:-[0-9a-zA-Z]+)?)\s+(.*)$'"
FAMILY = r"'(GB|JTG|JTJ|TB|JGJ|CJJ|DL|SL|YB)(/T)?\s*([A-Z]?\d{2,5})(-\d{4})?'"
NUMBER = r"'(-?\d+(?:\.\d+)?)\s*(%|[A-Za-z]+|‰)?'"
COS = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 9)"


def cos(a: str, b: str) -> str:
    return COS.format(a=a, b=b)


VECTORS = "vectors AS (SELECT 'D' || vec_id AS clause_id, 'S' || (vec_id % 50) AS standard_id, embedding AS dense, label FROM embeddings)"
CORPUS = f"""{VECTORS},
clauses AS (SELECT 'D' || doc_id AS clause_id, 'S' || (doc_id % 50) AS standard_id, (doc_id % 9 + 1) || '.1.1' AS clause_no, 'p' AS path, text FROM documents),
standards AS (SELECT 'S' || n AS standard_id, 'GB ' || (50000 + n) || '-2015' AS standard_no, 'name ' || n AS standard_name, CASE WHEN n % 5 = 0 THEN '作废' ELSE '现行' END AS status,
  CASE WHEN n % 7 = 0 THEN 'internal' WHEN n % 11 <> 0 THEN 'public' END AS access_level FROM range(50) t(n)),
questions AS (SELECT item_id AS question_id, CASE item_id % 4 WHEN 0 THEN 'GB ' || (50000 + item_id + 1) || '-2015 2.1.1 ' || text WHEN 1 THEN 'GB 59999-2015 ' || text ELSE text END AS question FROM benchmark WHERE item_id % 20 = 0),
asked AS (SELECT question_id, question, embedding AS query FROM questions JOIN embeddings ON vec_id = question_id)"""


def bm25(clauses: str, questions: str, name: str, extra: str = "TRUE") -> str:
    """CTEs that end with `name` (question_id, clause_id, standard_id, score, rank)."""
    return rf"""{name}_t AS (SELECT clause_id, standard_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ts FROM {clauses}),
{name}_s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM {name}_t),
{name}_p AS (SELECT token, clause_id, standard_id, dl, count(*) AS tf FROM (SELECT clause_id, standard_id, len(ts) AS dl, unnest(ts) AS token FROM {name}_t) GROUP BY ALL),
{name}_f AS (SELECT token, count(*) AS df FROM {name}_p GROUP BY token),
{name}_q AS (SELECT DISTINCT question_id, unnest(list_filter(string_split_regex(lower(question), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS token FROM {questions}),
{name}_w AS (SELECT question_id, clause_id, standard_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {name}_q JOIN {name}_p USING (token) JOIN {name}_f USING (token), {name}_s GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, clause_id) AS rank FROM {name}_w WHERE {extra})"""


def dense(vectors: str, asked: str, name: str, where: str = "TRUE") -> str:
    return f"""{name} AS (SELECT question_id, clause_id, standard_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, clause_id) AS rank
  FROM (SELECT question_id, clause_id, standard_id, {cos('query', 'dense')} AS score FROM {asked}, {vectors} WHERE {where}))"""


def rrf(lists: dict[str, str], name: str) -> str:
    parts = " UNION ALL ".join(f"SELECT question_id, clause_id, standard_id, rank, {k} AS list, '{source}' AS source FROM {cte}" for k, (source, cte) in enumerate(lists.items()))
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, clause_id) AS rank FROM (
  SELECT question_id, clause_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(source, '+' ORDER BY list) AS sources, min(standard_id) AS standard_id FROM ({parts}) GROUP BY question_id, clause_id))"""


VEC_ASKED = "asked AS (SELECT vec_id AS question_id, embedding AS query FROM embeddings WHERE vec_id % 20 = 0)"

HEADINGS = """headings AS (SELECT 'S' || (l_suppkey % 3) AS standard_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS ord,
  CASE WHEN l_linenumber = 4 AND l_orderkey % 50 < 40 THEN (l_orderkey % 50 + 1)::VARCHAR WHEN l_linenumber = 5 THEN (l_orderkey % 50 + 1) || '.' || (l_suppkey % 5 + 1)
    WHEN l_linenumber = 6 THEN '' ELSE (l_orderkey % 50 + 1) || '.' || (l_suppkey % 5 + 1) || '.' || l_linenumber END AS clause_no,
  'h' || l_partkey AS title, 't' || l_partkey AS text, l_linenumber - 1 AS page_no FROM lineitem),
nodes AS (SELECT standard_id, clause_no, min(ord) AS ord, arg_min(title, ord) AS title, string_agg(text, '' ORDER BY ord, text) AS text, arg_min(page_no, ord) AS page_start,
  len(string_split(clause_no, '.')) AS parts, regexp_extract(clause_no, '^(.*)\\.[^.]*$', 1) AS up FROM headings WHERE clause_no <> '' GROUP BY standard_id, clause_no),
tree AS (SELECT n.standard_id || ':' || n.clause_no AS node_id, n.standard_id, n.clause_no, CASE WHEN p.clause_no IS NULL THEN '' ELSE n.standard_id || ':' || p.clause_no END AS parent_id,
  CASE n.parts WHEN 1 THEN 'chapter' WHEN 2 THEN 'section' ELSE 'clause' END AS node_type, n.title, n.text, n.page_start, n.ord, p.text AS parent_text,
  CASE WHEN p.clause_no IS NULL THEN n.clause_no WHEN g.clause_no IS NULL THEN p.clause_no || ' / ' || n.clause_no ELSE g.clause_no || ' / ' || p.clause_no || ' / ' || n.clause_no END AS path,
  1 + (p.clause_no IS NOT NULL)::INT + (g.clause_no IS NOT NULL)::INT AS level
  FROM nodes n LEFT JOIN nodes p ON p.standard_id = n.standard_id AND p.clause_no = n.up LEFT JOIN nodes g ON g.standard_id = p.standard_id AND g.clause_no = p.up)"""

CELLS = r"""html AS (SELECT p_size AS page_no, p_partkey, 'S:T:' || p_size || ':' || p_partkey AS table_id, p_size, p_brand, printf('%.2f', p_retailprice) AS price FROM part)"""
MARKDOWN = "'| name | value (mm) | 说明（m） |' || chr(10) || '|---|---|---|' || chr(10) || '| size | ' || p_size || ' | - |' || chr(10) || '| retail | 约 ' || price || ' | ' || p_brand || ' |'"
BRAND_NO = r"nullif(regexp_extract(p_brand, '-?\d+(?:\.\d+)?', 0), '')"
CELL_ROWS = f"""cells AS (
  SELECT table_id, 1 AS row_idx, 1 AS col_idx, 'size' AS row_header, 'value (mm)' AS col_header, p_size::VARCHAR AS cell_text, p_size::DOUBLE AS number_value, 'mm' AS unit FROM html
  UNION ALL SELECT table_id, 1, 2, 'size', '说明（m）', '-', NULL, '' FROM html
  UNION ALL SELECT table_id, 2, 1, 'retail', 'value (mm)', '约 ' || price, price::DOUBLE, 'mm' FROM html
  UNION ALL SELECT table_id, 2, 2, 'retail', '说明（m）', p_brand, {BRAND_NO}::DOUBLE, CASE WHEN {BRAND_NO} IS NULL THEN '' ELSE 'm' END FROM html)"""

ANSWERS = """answers AS (SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN '未检索到相关依据' ELSE '依据第 ' || CASE conv_id % 3 WHEN 0 THEN '4.2.1' WHEN 1 THEN '14.2.1' ELSE '4.2.10' END || ' 条，压实度 ' || (90 + conv_id % 10) ||
  CASE WHEN conv_id % 2 = 0 THEN '%' ELSE ' mm' END || '，厚 ' || (conv_id % 7) || '.5' END AS answer,
  '4.2.1 14.2.1 压实度不应小于 ' || (90 + conv_id % 8) || CASE WHEN conv_id % 4 < 3 THEN '%' ELSE '' END || ' 厚 ' || (conv_id % 5) || '.50 m，' || text AS source, conv_id % 5 <> 0 AS should_answer
  FROM conversations)"""


def number_list(column: str) -> str:
    v, u, r = (f"regexp_extract_all({column}, {NUMBER}, {k})" for k in (1, 2, 0))
    return f"list_transform(list_zip({v}, {u}, {r}), lambda z: {{'v': z[1]::DOUBLE, 'u': coalesce(z[2], ''), 'r': z[3]}})"


def bad_numbers(answer: str, source: str) -> str:
    return f"list_filter({number_list(answer)}, lambda a: len(list_filter({number_list(source)}, lambda s: abs(s.v - a.v) <= 1e-9 AND (s.u = a.u OR s.u = '' OR a.u = ''))) = 0)"


CASES = f"""{VECTORS}, {VEC_ASKED.format(n=40)}, {dense('vectors', 'asked', 'found')},
gold AS (SELECT label, 'D' || min(vec_id) AS gold FROM embeddings GROUP BY label),
cases AS (SELECT a.vec_id AS question_id, g.gold, (SELECT min(f.rank) FROM found f WHERE f.question_id = a.vec_id AND f.clause_id = g.gold AND f.rank <= 10) AS pos FROM embeddings a JOIN gold g USING (label) WHERE a.vec_id % 20 = 0),
scored AS (SELECT question_id, gold, coalesce(pos <= 3, FALSE)::INT AS recall_3, coalesce(pos = 1, FALSE)::INT AS hit_1, coalesce(1.0::DOUBLE / pos, 0.0::DOUBLE) AS rr FROM cases)"""

FRAGMENT = """'{"clause_no":"' || clause_no || '","formulas":[],"is_mandatory":false,"path":"' || path || '","source_id":"S' || n || '","standard_name":"' || standard_name || '","standard_no":"' || standard_no || '","status":"' || status || '","tables":[],"text":"' || md5(text) || '"}'"""

ORDER_BATCHES = """batches AS (SELECT o_orderkey, o_orderstatus, o_totalprice AS price, 1 AS seq FROM orders UNION ALL SELECT o_orderkey, '现行', o_totalprice + 1, 2 FROM orders WHERE o_orderkey % 3 = 0)"""

DOC_LINES = rf"""numbered AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln, unnest(string_split(text, chr(10))) AS line FROM documents),
shown AS (SELECT doc_id, ln, CASE WHEN ln % 3 = 0 THEN (doc_id % 7 + 1) || '.' || (ln // 3 + 1) || '.2 ' || line ELSE '  ' || line END AS line FROM numbered),
folded AS (SELECT doc_id, ln, replace(translate(line, '　０１２３４５６７８９．', ' 0123456789.'), chr(13), '') AS line FROM shown)"""

SQL: dict[str, str] = {
    "dense_topk": f"SELECT question_id, clause_id, score, rank FROM (SELECT q.vec_id AS question_id, 'D' || v.vec_id AS clause_id, {cos('q.embedding', 'v.embedding')} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {cos('q.embedding', 'v.embedding')} DESC, 'D' || v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) WHERE rank <= 5",
    "dense_filtered_topk": f"SELECT question_id, clause_id, score, rank FROM (SELECT q.vec_id AS question_id, 'D' || v.vec_id AS clause_id, {cos('q.embedding', 'v.embedding')} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {cos('q.embedding', 'v.embedding')} DESC, 'D' || v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.label % 2 = 0) WHERE rank <= 5",
    "dense_batch_topk": f"WITH {VECTORS}, {VEC_ASKED.format(n=20)}, {dense('vectors', 'asked', 'd')} SELECT question_id, clause_id, score, rank::INT AS rank FROM d WHERE rank <= 5",
    "bm25_topk": f"WITH {CORPUS}, {bm25('clauses', 'questions', 'b')} SELECT question_id, clause_id, score, rank::INT AS rank FROM b WHERE rank <= 5",
    "synonym_expand": "SELECT conv_id, turn, text || "
    + " || ".join(f"CASE WHEN contains(text, '{a}') AND NOT contains(text, '{b}') THEN ' {b}' ELSE '' END" for a, b in (("and", "und"), ("das", "la"), ("das", "the"), ("de", "of"), ("la", "das"), ("la", "the"), ("of", "de"), ("the", "das"), ("the", "la"), ("und", "and")))
    + " AS expanded FROM conversations",
    "query_analysis": rf"""WITH q AS (SELECT conv_id || '/' || turn AS question_id, 'GB/T ' || (50000 + conv_id) || '-2019 第' || (turn + 1) || '.' || (conv_id % 9 + 1) || '.1条 ' || CASE WHEN conv_id % 3 = 0 THEN '限值 ' ELSE '' END || text AS question FROM conversations)
SELECT question_id, regexp_extract(question, {FAMILY}, 0) AS standard_no, regexp_extract(regexp_replace(question, {FAMILY}, ' ', 'g'), '\d+(?:\.\d+){{1,3}}(?:-[0-9a-zA-Z]+)?', 0) AS clause_no,
  regexp_matches(question, '表|限值|指标|单位|数值|取值|不应小于|不应大于') AS wants_table FROM q""",
    "rrf_fuse": f"WITH {CORPUS}, {dense('vectors', 'asked', 'd')}, {bm25('clauses', 'asked', 'b')}, d20 AS (SELECT * FROM d WHERE rank <= 20), b20 AS (SELECT * FROM b WHERE rank <= 20), {rrf({'dense': 'd20', 'bm25': 'b20'}, 'r')} SELECT question_id, clause_id, score, sources, rank::INT AS rank FROM r WHERE rank <= 10",
    "text_retrieve": rf"""WITH {CORPUS}, named AS (SELECT question_id, regexp_extract(question, {FAMILY}, 0) AS no, regexp_extract(regexp_replace(question, {FAMILY}, ' ', 'g'), '\d+(?:\.\d+){{1,3}}(?:-[0-9a-zA-Z]+)?', 0) AS clause_no FROM questions),
narrow AS (SELECT question_id, no, clause_no, coalesce(standard_id, CASE WHEN no <> '' THEN '' END) AS standard_id FROM named LEFT JOIN standards ON standard_no = no),
admitted AS (SELECT standard_id FROM standards WHERE status = '现行' AND coalesce(access_level, 'public') = 'public'),
v AS (SELECT * FROM vectors SEMI JOIN admitted USING (standard_id)), c AS (SELECT * FROM clauses SEMI JOIN admitted USING (standard_id)),
{dense('v', '(SELECT a.*, o.standard_id AS only_id FROM asked a JOIN narrow o USING (question_id))', 'd', "only_id IS NULL OR only_id = standard_id")},
{bm25('c', 'asked', 'b', "coalesce((SELECT o.standard_id FROM narrow o WHERE o.question_id = b_w.question_id), standard_id) = standard_id")},
x AS (SELECT question_id, clause_id, standard_id, row_number() OVER (PARTITION BY question_id ORDER BY clause_id) AS rank FROM (SELECT o.question_id, k.clause_id, k.standard_id FROM narrow o JOIN clauses k ON k.standard_id = o.standard_id AND k.clause_no = o.clause_no WHERE o.no <> '' AND o.clause_no <> '')),
d20 AS (SELECT * FROM d WHERE rank <= 20), b20 AS (SELECT * FROM b WHERE rank <= 20), x20 AS (SELECT * FROM x WHERE rank <= 20), {rrf({'dense': 'd20', 'bm25': 'b20', 'pg_exact': 'x20'}, 'r')}
SELECT question_id, clause_id, score, sources, rank::INT AS rank FROM r JOIN standards s USING (standard_id) WHERE rank <= 10 AND coalesce(access_level, 'public') = 'public'""",
    "rerank": f"""WITH {CORPUS}, {dense('vectors', 'asked', 'd')}, {bm25('clauses', 'asked', 'b')}, d20 AS (SELECT * FROM d WHERE rank <= 20), b20 AS (SELECT * FROM b WHERE rank <= 20), {rrf({'dense': 'd20', 'bm25': 'b20'}, 'r')},
ds AS (SELECT question_id, clause_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM d20 WINDOW w AS (PARTITION BY question_id)),
bs AS (SELECT question_id, clause_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM b20 WINDOW w AS (PARTITION BY question_id)),
m AS (SELECT r.question_id, r.clause_id, round(0.5 * coalesce(ds.s, 0.0::DOUBLE) + 0.5 * coalesce(bs.s, 0.0::DOUBLE), 9) AS score FROM r LEFT JOIN ds USING (question_id, clause_id) LEFT JOIN bs USING (question_id, clause_id) WHERE r.rank <= 20)
SELECT question_id, clause_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, clause_id) AS rank FROM m) WHERE rank <= 5""",
    "exact_lookup": """WITH std AS (SELECT 'S' || o_orderkey AS standard_id, 'GB ' || (50000 + o_orderkey % 2000) || '-2010' AS standard_no, o_orderstatus = 'F' AS retired FROM orders),
best AS (SELECT standard_no, standard_id FROM (SELECT *, row_number() OVER (PARTITION BY standard_no ORDER BY retired, standard_id) AS n FROM std) WHERE n = 1),
cl AS (SELECT DISTINCT 'S' || l_orderkey AS standard_id, l_linenumber || '.' || (l_suppkey % 2 + 1) || '.1' AS clause_no FROM lineitem)
SELECT event_id AS question_id, cl.standard_id || ':' || cl.clause_no AS clause_id, cl.standard_id FROM events JOIN best ON standard_no = 'GB ' || (50000 + event_id * 7 % 2000) || '-2010' JOIN cl ON cl.standard_id = best.standard_id AND cl.clause_no = '1.1.1' WHERE event_id % 20 = 0""",
    "clause_split": rf"""WITH {DOC_LINES}, heads AS (SELECT *, regexp_extract(line, {HEAD}, 1) AS no FROM folded),
marked AS (SELECT *, sum((no <> '')::INT) OVER (PARTITION BY doc_id ORDER BY ln) AS ord FROM heads)
SELECT doc_id::VARCHAR AS doc_path, ord::BIGINT AS ord, max(no) AS clause_no, string_agg(CASE WHEN no <> '' THEN regexp_extract(line, {HEAD}, 2) ELSE regexp_replace(line, '^[ \t\r]+', '') END, '' ORDER BY ln) AS text FROM marked WHERE ord > 0 GROUP BY doc_id, ord""",
    "element_scan": rf"""WITH {DOC_LINES}, heads AS (SELECT *, regexp_extract(line, {HEAD}, 1) AS h, regexp_extract(line, '^\s*第?(\d{{1,2}})\s*章?\s+([^\d\s][^\d]{{0,29}})$', 1) AS ch FROM folded WHERE regexp_matches(line, '[^ \t\r\n]')),
marked AS (SELECT *, CASE WHEN h <> '' THEN h ELSE ch END AS no, sum((h <> '' OR ch <> '')::INT) OVER (PARTITION BY doc_id ORDER BY ln) AS ord FROM heads),
pieces AS (SELECT *, CASE WHEN h <> '' THEN regexp_extract(line, {HEAD}, 2) WHEN ch <> '' THEN regexp_extract(line, '^\s*第?(\d{{1,2}})\s*章?\s+([^\d\s][^\d]{{0,29}})$', 2) ELSE trim(line, ' ') END AS piece FROM marked)
SELECT doc_id::VARCHAR AS doc_path, ord::BIGINT AS ord, max(no) AS clause_no, CASE WHEN max(h) <> '' THEN 3 ELSE 1 END::INT AS level, max(CASE WHEN no <> '' THEN piece END) AS title, length(string_agg(piece, '' ORDER BY ln))::INT AS n_chars FROM pieces WHERE ord > 0 GROUP BY doc_id, ord""",
    "standard_no": r"""SELECT p_partkey, coalesce(nullif(regexp_extract(CASE WHEN p_partkey % 5 <> 0 THEN p_name || ' GB ' || (50000 + p_partkey) || '-' || (1990 + p_size % 30) ELSE p_name END, '[A-Z]{2,}(?:/[A-Z]+)?[ \t]*[A-Z]{0,2}\d+(?:\.\d+)?-(?:19|20)\d{2}', 0), ''), 'file.' || p_partkey) AS standard_no,
  'file.' || p_partkey || '.pdf' AS file_name, TRUE AS is_pdf FROM part""",
    "standard_normalize": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'GB/T ' ELSE 'JTG ' END || (p_partkey + 10000) || '-' || (1990 + p_size % 30) AS standard_no, TRUE AS valid FROM part",
    "standard_upsert": f"WITH {ORDER_BATCHES} SELECT o_orderkey, arg_max(o_orderstatus, seq) AS o_orderstatus, round(arg_max(price, seq), 2) AS price FROM batches GROUP BY o_orderkey",
    "clause_upsert": "WITH r AS (SELECT l_orderkey || ':' || (l_linenumber % 3) AS node_id, 't' || l_partkey AS text, 'h' || l_suppkey AS title, l_linenumber AS page_start, (l_linenumber * 10000000 + l_partkey) * 100000 + l_suppkey AS seq FROM lineitem) SELECT node_id, arg_max(text, seq) AS text, arg_min(title, seq) AS title, arg_min(page_start, seq) AS page_start FROM r GROUP BY node_id",
    "review_status": "WITH g AS (SELECT l_orderkey, count(*) > 3 AS passed FROM lineitem GROUP BY 1) SELECT o_orderkey AS standard_id, CASE WHEN passed THEN 'passed' WHEN NOT passed THEN 'pending_review' ELSE 'new' END AS review_status FROM orders LEFT JOIN g ON l_orderkey = o_orderkey",
    "orphan_check": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 10 <> 0)",
    "clause_tree": f"WITH {HEADINGS} SELECT node_id, parent_id, node_type, path, level::BIGINT AS level, page_start, title, md5(text) AS text_md5 FROM tree",
    "chunk_build": f"WITH {HEADINGS} SELECT node_id || '#' || node_type AS chunk_id, node_type AS chunk_type, md5('GB ' || (50000 + substr(standard_id, 2)::INT) || '-2015 name' || substr(standard_id, 2) || ' ' || path || ' ' || clause_no || ' ' || text) AS retrieval_md5, md5(coalesce(parent_text, text)) AS context_md5 FROM tree WHERE node_type <> 'chapter'",
    "page_map": f"WITH {HEADINGS} SELECT standard_id, page_start AS page_no, node_id, 'full' AS coverage_type FROM tree WHERE page_start > 0",
    "table_cells": f"WITH {CELLS}, {CELL_ROWS} SELECT * REPLACE (coalesce(number_value, -1) AS number_value) FROM cells",
    "table_markdown": f"WITH {CELLS} SELECT table_id, {MARKDOWN} AS table_markdown FROM html",
    "table_owner": f"WITH {HEADINGS}, firsts AS (SELECT standard_id, page_start, arg_min(node_id, ord) AS owner FROM tree GROUP BY 1, 2) SELECT p_partkey, coalesce(owner, 'S' || (p_partkey % 4)) AS node_id FROM part LEFT JOIN firsts ON standard_id = 'S' || (p_partkey % 4) AND page_start = p_size % 9",
    "parser_route": r"""WITH p AS (SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, page_id % 4 AS parity, CASE WHEN page_id % 2 = 0 THEN url ELSE html END AS text FROM pages),
s AS (SELECT host, parity, count(*) AS pages, (sum(octet_length(encode(text))) // count(*))::BIGINT AS avg_bytes FROM p GROUP BY 1, 2) SELECT *, CASE WHEN parity = 3 OR avg_bytes < 100 THEN 'layout' ELSE 'text' END AS route FROM s""",
    "quality_gate": """WITH r AS (SELECT source, count(*) AS docs, sum((coalesce(quality, 0) = 1)::INT) AS ok, avg(coalesce(quality, 1)) AS conf FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT source, array_to_string(list_filter([CASE WHEN docs % 7 = 0 THEN 'standard_no_missing' END, CASE WHEN ok = 0 THEN 'no_clauses' END, CASE WHEN conf < 0.8 THEN 'low_ocr_confidence' END], lambda x: x IS NOT NULL), ',') AS issues, NOT (docs % 7 = 0 OR ok = 0 OR conf < 0.8) AS passed FROM r""",
    "context_fragments": f"""WITH {CORPUS}, {dense('vectors', 'asked', 'd')}, f AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS n, c.clause_no, c.path, c.text, coalesce(s.standard_no, '') AS standard_no, coalesce(s.standard_name, '') AS standard_name, coalesce(s.status, '') AS status
  FROM d JOIN clauses c USING (clause_id) LEFT JOIN (SELECT * FROM standards WHERE standard_id <> 'S7') s ON s.standard_id = c.standard_id WHERE rank <= 5 AND c.clause_id NOT LIKE '%3')
SELECT question_id, count(*) AS n_fragments, '[' || string_agg({FRAGMENT}, ',' ORDER BY n) || ']' AS context FROM f GROUP BY question_id""",
    "prompts": f"""WITH {CORPUS}, {dense('vectors', 'asked', 'd')}, rec AS (SELECT DISTINCT question_id FROM d WHERE rank <= 5 AND question_id > 0),
ok AS (SELECT DISTINCT question_id FROM d JOIN clauses c USING (clause_id) WHERE rank <= 5 AND question_id > 0 AND question_id % 60 <> 40 AND c.clause_id NOT LIKE '%3' AND c.clause_id <> 'D1')
SELECT question_id, question_id IN (SELECT question_id FROM ok) AS asks, CASE WHEN question_id NOT IN (SELECT question_id FROM rec) THEN '{C.NO_CANDIDATES}' WHEN question_id NOT IN (SELECT question_id FROM ok) THEN '{C.NO_SOURCE}' ELSE '' END AS refusal FROM asked""",
    "small_to_big": f"""WITH {CORPUS}, {dense('vectors', 'asked', 'd')} SELECT question_id, 'S' || row_number() OVER (PARTITION BY question_id ORDER BY rank) AS source_id,
  md5(c.text || CASE WHEN substr(clause_id, 2)::BIGINT % 2 = 0 THEN chr(10) || '【父级上下文】ctx ' || c.clause_no ELSE '' END) AS text_md5 FROM d JOIN clauses c USING (clause_id) WHERE rank <= 5""",
    "numeric_verify": f"WITH {ANSWERS} SELECT conv_id, turn, len({number_list('answer')}) AS n_numbers, coalesce(array_to_string(list_transform({bad_numbers('answer', 'source')}, lambda x: x.r), ';'), '') AS unverified FROM answers",
    "numeric_intercept": f"""WITH {ANSWERS}, v AS (SELECT conv_id, turn, answer, source, len({bad_numbers('answer', "(source || ' 4.2.1 JTG D60-2015')")}) = 0 OR regexp_matches(answer, '未检索到') AS fine FROM answers)
SELECT conv_id || '/' || turn AS question_id, fine AS all_verified, md5(CASE WHEN fine THEN answer ELSE '{C.NOT_VERIFIED}' || source END) AS final_md5 FROM v""",
    "citation_refusal": rf"""WITH {ANSWERS} SELECT conv_id, turn, regexp_matches(answer, '4\.2\.1([^0-9]|$)') AS cited, regexp_matches(answer, '(^|[^0-9.])4\.2\.1([^0-9.]|$)') AS cited_strict, regexp_matches(answer, '无法作答|未检索到|无法从规范|拒答|未能准确生成') AS refused,
  should_answer <> regexp_matches(answer, '无法作答|未检索到|无法从规范|拒答|未能准确生成') AS refusal_ok FROM answers""",
    "retrieval_metrics": f"WITH {CASES} SELECT question_id, recall_3, hit_1, round(rr, 9) AS rr FROM scored",
    "eval_summary": f"""WITH {CASES} SELECT count(*) AS total, round(avg(recall_3) FILTER (question_id // 20 % 5 <> 0), 9) AS recall_at_3, round(avg(rr) FILTER (question_id // 20 % 5 <> 0), 9) AS mrr, round(avg(hit_1) FILTER (question_id // 20 % 5 <> 0), 9) AS hit_at_1,
  round(avg((question_id // 20 % 3 = 0)::INT) FILTER (question_id // 20 % 4 <> 0 AND question_id // 20 % 2 = 0), 9) AS citation_accuracy, round(avg((question_id // 20 % 7 <> 0)::INT), 9) AS refusal_accuracy, count(*) FILTER (question_id // 20 % 4 <> 0 AND question_id // 20 % 2 = 0) AS generation_evaluated FROM scored""",
    "ab_compare": f"""WITH {CASES}, m AS (SELECT avg(recall_3) FILTER (question_id // 20 % 2 = 0) AS ra, avg(recall_3) FILTER (question_id // 20 % 2 = 1) AS rb, avg(rr) FILTER (question_id // 20 % 2 = 0) AS sa, avg(rr) FILTER (question_id // 20 % 2 = 1) AS sb FROM scored)
SELECT 'recall_3' AS metric, round(ra, 9) AS base_mean, round(rb, 9) AS other_mean, round(rb - ra, 9) AS delta FROM m UNION ALL SELECT 'rr', round(sa, 9), round(sb, 9), round(sb - sa, 9) FROM m""",
    "threshold_calib": """WITH s AS (SELECT round(n_chars % 997 / 997.0::DOUBLE + quality * 0.3::DOUBLE, 3) AS score, quality = 1 AS yes FROM documents JOIN labels USING (doc_id)),
cuts AS (SELECT DISTINCT score AS cut FROM s), n AS (SELECT count(*) FILTER (yes) AS y, count(*) FILTER (NOT yes) AS x FROM s),
rated AS (SELECT cut, (SELECT count(*) FROM s WHERE yes AND score < cut) / y::DOUBLE AS f, (SELECT count(*) FROM s WHERE NOT yes AND score >= cut) / x::DOUBLE AS w FROM cuts, n)
SELECT round(cut, 9) AS threshold, round(f, 9) AS false_refusal_rate, round(w, 9) AS wrong_answer_rate FROM rated ORDER BY round(f + w, 12), cut DESC LIMIT 1""",
    "access_guard": f"WITH {CORPUS} SELECT clause_id, status AS effective_status FROM clauses JOIN standards USING (standard_id) WHERE status = '现行' AND coalesce(access_level, 'public') = 'public' AND clause_id NOT LIKE '%9'",
    "reference_expand": """WITH hits AS (SELECT o_orderkey % 5 AS question_id, o_orderkey AS clause_id FROM orders),
steps AS (SELECT DISTINCT question_id, clause_id + d AS clause_id FROM hits, (VALUES (-1), (1)) t(d)), fresh AS (SELECT * FROM steps ANTI JOIN hits USING (question_id, clause_id))
SELECT question_id, clause_id, CASE WHEN o_orderstatus = 'F' THEN 'warning' ELSE 'aux' END AS kind FROM fresh JOIN orders ON o_orderkey = clause_id""",
    "cell_locator": f"""WITH {CELLS}, q AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN '约 ' || price WHEN 1 THEN p_size::VARCHAR END AS cell FROM html)
SELECT p_partkey AS question_id, (cell IS NOT NULL)::BIGINT AS n_cells, coalesce(cell, {MARKDOWN}) AS answer FROM q""",
    "token_budget": "WITH r AS (SELECT doc_id % 10 AS question_id, doc_id % 4 + 1 AS p, doc_id AS ord, sum(length(text)) OVER (PARTITION BY doc_id % 10 ORDER BY doc_id % 4 + 1, doc_id) AS running FROM documents) SELECT question_id, ord, running::BIGINT AS running FROM r WHERE running <= 60000 OR p = 1",
    "version_chain": """WITH v AS (SELECT p_brand, p_partkey, DATE '2000-01-01' + (p_partkey * 13 % 9000)::INT AS eff FROM part),
w AS (SELECT p_partkey AS standard_id, eff, lead(eff) OVER o AS nxt, lag(p_partkey) OVER o AS replaces, lead(p_partkey) OVER o AS replaced_by FROM v WINDOW o AS (PARTITION BY p_brand ORDER BY eff, p_partkey))
SELECT standard_id, CASE WHEN eff > DATE '2015-06-30' THEN '即将实施' WHEN nxt IS NULL OR nxt > DATE '2015-06-30' THEN '现行' ELSE '作废' END AS status, coalesce(replaces, -1) AS replaces, coalesce(replaced_by, -1) AS replaced_by FROM w""",
    "supersede": "SELECT p.p_partkey AS clause_id, a.p_partkey IS NOT NULL AS revised, a.p_brand AS revision_source FROM part p LEFT JOIN part a ON a.p_partkey = p.p_partkey + 1 AND a.p_partkey % 6 = 0 AND a.p_size % 2 = 0",
    "reconcile": """WITH t AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 4 <> 0), i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS s FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(t.k, i.k) AS node_id, CASE WHEN i.k IS NULL THEN 'insert' WHEN t.k IS NULL THEN 'delete' WHEN t.s IS DISTINCT FROM i.s THEN 'update' ELSE 'ok' END AS action FROM t FULL JOIN i ON t.k = i.k""",
    "metadata_enrich": "SELECT p_partkey AS node_id, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ' || least(p_type, p_brand) || ' ' || greatest(p_type, p_brand) || ' what is ' || p_name ELSE '' END AS retrieval_text FROM part",
    "visual_page_recall": f"""WITH pages_v AS (SELECT 'P' || vec_id AS clause_id, '' AS standard_id, embedding AS dense, vec_id FROM embeddings), {VEC_ASKED.format(n=5)}, {dense('pages_v', 'asked', 'd')},
m AS (SELECT question_id, 'C' || (substr(clause_id, 2)::INT % 60) AS clause_id, max(score) AS score, string_agg(clause_id, ',' ORDER BY clause_id) AS pages FROM d WHERE rank <= 30 GROUP BY 1, 2)
SELECT question_id, clause_id, score, pages, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, clause_id) AS rank FROM m) WHERE rank <= 5""",
    "block_clauses": """WITH b AS (SELECT l_orderkey || '-' || l_linenumber AS block_id, l_suppkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 'N' || l_partkey END AS rel FROM lineitem WHERE l_partkey % 11 <> 0 AND l_discount * 10 >= 0.3::DOUBLE)
SELECT block_id, rel AS node_id FROM b WHERE rel IS NOT NULL UNION ALL SELECT block_id, 'M' || s_suppkey FROM b JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 7 + 1 = l_linenumber WHERE rel IS NULL""",
    "mode_router": rf"""WITH q AS (SELECT conv_id || '/' || turn AS question_id, turn / 7.0::DOUBLE AS conf, CASE conv_id % 6 WHEN 0 THEN 'GB 50010-2010 ' WHEN 1 THEN '表 ' WHEN 2 THEN '第3页 ' WHEN 3 THEN '流程图 ' ELSE '' END || text AS q FROM conversations)
SELECT question_id, CASE WHEN regexp_matches(q, {FAMILY}) OR regexp_matches(q, '\d+\.\d+') THEN 'text' WHEN regexp_matches(q, '表|限值|指标|单位|数值|取值|不应小于|不应大于') THEN 'text' WHEN regexp_matches(q, '第[0-9一二三四五六七八九十]+页|第几页') THEN 'visual' WHEN regexp_matches(q, '图') THEN 'both' WHEN conf < 0.5 THEN 'visual' ELSE 'text' END AS mode FROM q""",
    "cross_modal_fuse": f"""WITH {VECTORS}, {VEC_ASKED.format(n=5)}, {dense('vectors', 'asked', 'a', 'label < 6')}, {dense('vectors', 'asked', 'b', 'label > 3')},
u AS (SELECT question_id, clause_id, score, 0 AS l, 'text' AS source FROM a WHERE rank <= 10 UNION ALL SELECT question_id, clause_id, score, 1, 'visual' FROM b WHERE rank <= 10),
s AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS z FROM u WINDOW w AS (PARTITION BY question_id, l)),
m AS (SELECT question_id, clause_id, round(sum(0.5 * z), 9) AS score, string_agg(source, '+' ORDER BY l) AS sources FROM s GROUP BY 1, 2)
SELECT question_id, clause_id, score, sources, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, clause_id) AS rank FROM m) WHERE rank <= 5""",
    "degrade": f"WITH {CORPUS}, {bm25('clauses', 'asked', 'b')} SELECT question_id, clause_id, 'bm25' AS sources, rank::INT AS rank FROM b WHERE rank <= 5",
    "cache_keys": "SELECT conv_id, turn, sha256(text || chr(1) || CASE WHEN turn % 2 = 0 THEN 'public' ELSE 'internal' END || chr(1) || 'v1') AS cache_key FROM conversations",
    "doc_dump_stats": "SELECT source AS doc_path, count(*) AS pages, sum(CASE WHEN doc_id % 50 < 3 THEN 3 ELSE octet_length(encode(text)) END)::BIGINT AS bytes, min(CASE WHEN doc_id % 50 >= 3 AND regexp_matches(text, '[^ \\t\\r\\n]') THEN doc_id END) AS first_page FROM documents GROUP BY source",
    "layout_elements": "SELECT 'f' || p_partkey AS source_path, 0::BIGINT AS ord, 'Heading' AS type, p_size AS page_no, p_size || '.2' AS clause_no, p_size || '.2 ' || p_name AS text FROM part UNION ALL SELECT 'f' || p_partkey, 1, 'Text', p_size + 1, '', p_type FROM part",
}

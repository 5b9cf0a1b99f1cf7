"""Queries over whole flows (ingest, prompts, answers, evaluation, versions) and over readers, each with its DuckDB SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators import structure as S
from ..operators import versioning as V
from ..session import table
from ..sources import readers
from . import ingest as I
from .catalogue import Query
from .catalogue_inputs import clause_pages, corpus, headings, questions_with_vectors, vectors_of
from .catalogue_sql import CORPUS, DOC_LINES, HEAD, HEADINGS, VECTORS, bad_numbers, bm25, dense, rrf

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""SELECT p_partkey, i AS ord, ['Heading', 'Table', NULL, 'Text'][i + 1] AS type, [2, 0, NULL, 0][i + 1] AS level, [p_size + 1, p_size + 2, NULL, 1][i + 1] AS page_no,
  [p_name, '', NULL, p_brand][i + 1] AS text, ['', '<table></table>', NULL, ''][i + 1] AS table_html, ['', p_type, NULL, ''][i + 1] AS caption FROM part, range(4) t(i) WHERE i <> 2""")
def content_list(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    item = lambda **f: F.struct(*[v.alias(k) for k, v in f.items()])
    none, text = F.lit(None).cast("string"), F.lit("text")
    size = F.col("p_size").cast("int")
    items = F.array(
        item(type=text, page_idx=size, text=F.col("p_name"), text_level=F.lit(2), table_body=none, table_caption=none), item(type=F.lit("table"), page_idx=size + 1, text=none, text_level=F.lit(None).cast("int"), table_body=F.lit("<table></table>"), table_caption=F.col("p_type")),
        item(type=F.lit("image"), page_idx=size, text=none, text_level=F.lit(None).cast("int"), table_body=none, table_caption=none), item(type=text, page_idx=F.lit(None).cast("int"), text=F.col("p_brand"), text_level=F.lit(0), table_body=none, table_caption=none),
    )
    docs = p.select(F.col("p_partkey").alias("doc_path"), F.to_json(items).alias("json"))
    return readers.content_list(docs).select(F.col("doc_path").alias("p_partkey"), F.col("ord").cast("long").alias("ord"), "type", "level", "page_no", "text", "table_html", "caption")


@query("SELECT p_partkey, p_name || '|' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '|' || p_type END AS terms FROM part WHERE p_partkey % 7 <> 0")
def dictionary_lines(spark, sf) -> DataFrame:
    line = F.concat(F.when(F.col("p_partkey") % 7 == 0, " # ").otherwise(""), "p_name", F.lit(" ,, "), "p_brand", F.when(F.col("p_partkey") % 3 == 0, " , ").otherwise(F.concat(F.lit(","), "p_type")))
    return readers.dictionary(table(spark, sf, "part").select("p_partkey", line.alias("line"))).select("p_partkey", F.array_join("terms", "|").alias("terms"))


@query("""SELECT item_id, text AS question, 'GB ' || item_id AS gold_standard_no, '' AS gold_clause_no, item_id % 2 = 0 AS must_cite, TRUE AS should_answer FROM benchmark
UNION ALL SELECT item_id, '', '', item_id || '.1', FALSE, FALSE FROM benchmark""")
def eval_sets(spark, sf) -> DataFrame:
    case = lambda **f: F.to_json(F.struct(*[v.alias(k) for k, v in f.items()]))
    first = case(question=F.col("text"), gold_standard_no=F.concat(F.lit("GB "), "item_id"), must_cite=F.when(F.col("item_id") % 2 == 0, True))
    second = case(gold_clause_no=F.concat("item_id", F.lit(".1")), should_answer=F.lit(False))
    rows = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("["), first, F.lit(","), second, F.lit("]")).alias("json"))
    return readers.eval_cases_of(rows).select("item_id", "question", "gold_standard_no", "gold_clause_no", "must_cite", "should_answer")


@query("""WITH best AS (SELECT p_brand AS standard_no, min(p_partkey) AS id FROM part WHERE p_size % 2 = 0 GROUP BY p_brand)
SELECT p.p_partkey AS case_id, CASE WHEN b.id IS NOT NULL AND p.p_size % 5 <> 0 THEN b.id || ':' || p.p_size || '.1' END AS gold FROM part p LEFT JOIN best b ON b.standard_no = p.p_brand AND p.p_partkey % 3 <> 0""")
def gold_ids(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    known = p.filter("p_size % 2 = 0").groupBy(F.col("p_brand").alias("standard_no")).agg(F.min("p_partkey").cast("string").alias("standard_id"))
    cases = p.select(F.col("p_partkey").alias("case_id"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).otherwise("none").alias("gold_standard_no"), F.when(F.col("p_size") % 5 != 0, F.concat("p_size", F.lit(".1"))).otherwise("").alias("gold_clause_no"))
    return E.gold_ids(cases, known).select("case_id", "gold")


FOUND = f"""f AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY rank, clause_id) AS n, c.clause_no, c.path, c.text, s.standard_no, s.standard_name, s.status
  FROM d JOIN clauses c USING (clause_id) JOIN standards s ON s.standard_id = c.standard_id WHERE rank <= 5)"""
INDENTED = """'  {' || chr(10) || '    "clause_no": "' || clause_no || '",' || chr(10) || '    "formulas": [],' || chr(10) || '    "is_mandatory": false,' || chr(10) || '    "path": "' || path || '",' || chr(10) || '    "source_id": "S' || n || '",' || chr(10)
 || '    "standard_name": "' || standard_name || '",' || chr(10) || '    "standard_no": "' || standard_no || '",' || chr(10) || '    "status": "' || status || '",' || chr(10) || '    "tables": [],' || chr(10) || '    "text": ' || to_json(text)::VARCHAR || chr(10) || '  }'"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"""WITH {CORPUS}, {dense('vectors', 'asked', 'd')}, {FOUND}, c AS (SELECT question_id, '[' || chr(10) || string_agg({INDENTED}, ',' || chr(10) ORDER BY n) || chr(10) || ']' AS context FROM f GROUP BY question_id)
SELECT question_id, {quoted(C.SYSTEM_PROMPT)} AS system_prompt, {quoted(C.QUESTION_MARK)} || question || {quoted(C.CONTEXT_MARK)} || context || {quoted(C.CLOSING)} AS user_prompt FROM asked JOIN c USING (question_id)""")
def prompt_text(spark, sf) -> DataFrame:
    vectors, clauses, standards = corpus(spark, sf)
    q = questions_with_vectors(spark, sf)
    found = R.dense_top_k(q, vectors, 5)
    return C.prompts(q, found, C.context_json(C.fragments(found, clauses, standards), indent=True)).select("question_id", "system_prompt", "user_prompt")


@query(f"""WITH {CORPUS}, {dense('vectors', 'asked', 'd')}, {FOUND},
a AS (SELECT question_id, '依据《' || standard_name || '》（' || standard_no || '）第 ' || clause_no || ' 条：' || text AS answer FROM f WHERE n = 1),
s AS (SELECT question_id, string_agg(text || ' ' || clause_no || ' ' || standard_no, chr(10) ORDER BY n) AS source, string_agg(text, chr(10) ORDER BY n) AS quoted FROM f GROUP BY question_id),
v AS (SELECT *, len({bad_numbers('answer', 'source')}) = 0 AS fine FROM a JOIN s USING (question_id))
SELECT question_id, answer, fine AS all_verified, CASE WHEN fine THEN answer ELSE '{C.NOT_VERIFIED}' || quoted END AS final FROM v""")
def answer_final(spark, sf) -> DataFrame:
    vectors, clauses, standards = corpus(spark, sf)
    q = questions_with_vectors(spark, sf)
    return C.answer(q, R.dense_top_k(q, vectors, 5), clauses, standards)


@query(f"""WITH {VECTORS}, asked AS (SELECT vec_id AS question_id, embedding AS query FROM embeddings WHERE vec_id % 20 = 0), {dense('vectors', 'asked', 'd')},
r AS (SELECT question_id, standard_id || ':' || (substr(clause_id, 2)::BIGINT % 9 + 1) || '.1.1' AS node, rank FROM d WHERE rank <= 10),
c AS (SELECT vec_id AS id, CASE WHEN vec_id // 20 % 6 <> 0 THEN 'S' || (vec_id % 50) || ':' || (vec_id % 9 + 1) || '.1.1' END AS gold, vec_id // 20 % 4 <> 0 AS should_answer, vec_id // 20 % 3 <> 0 AS must_cite, vec_id // 20 % 5 = 0 AS refused FROM embeddings WHERE vec_id % 20 = 0),
m AS (SELECT *, (SELECT min(rank) FROM r WHERE r.question_id = c.id AND r.node = c.gold) AS pos FROM c)
SELECT count(*) AS total, round(coalesce(avg(coalesce(pos <= 3, FALSE)::INT) FILTER (gold IS NOT NULL), 0), 9) AS recall_at_3, round(coalesce(avg(coalesce(1.0::DOUBLE / pos, 0)) FILTER (gold IS NOT NULL), 0), 9) AS mrr,
  round(coalesce(avg(coalesce(pos = 1, FALSE)::INT) FILTER (gold IS NOT NULL), 0), 9) AS hit_at_1, round(coalesce(avg((NOT refused)::INT) FILTER (should_answer AND must_cite), 0), 9) AS citation_accuracy,
  round(avg((should_answer <> refused)::INT), 9) AS refusal_accuracy, count(*) FILTER (should_answer AND must_cite) AS generation_evaluated FROM m""")
def eval_run(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    own = e.filter("vec_id % 20 = 0").withColumn("n", F.expr("vec_id div 20"))
    number = lambda i: F.concat((i % 9 + 1).cast("string"), F.lit(".1.1"))
    found = R.dense_top_k(own.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query")), vectors_of(e), 10)
    candidates = found.select(F.col("question_id").alias("case_id"), F.concat_ws(":", "standard_id", number(F.substring("clause_id", 2, 20).cast("long"))).alias("clause_id"), "rank")
    cases = own.select(F.col("vec_id").alias("case_id"), F.when(F.col("n") % 6 != 0, F.concat(F.lit("GB "), F.col("vec_id") % 50)).otherwise("?").alias("gold_standard_no"), number(F.col("vec_id")).alias("gold_clause_no"), (F.col("n") % 4 != 0).alias("should_answer"), (F.col("n") % 3 != 0).alias("must_cite"))
    answers = own.select(F.col("vec_id").alias("case_id"), F.when(F.col("n") % 5 == 0, "无法作答").otherwise(F.concat(F.lit("依据第 "), number(F.col("vec_id")), F.lit(" 条"))).alias("answer"))
    return E.run(cases, candidates, answers, spark.range(50).select(F.concat(F.lit("GB "), "id").alias("standard_no"), F.concat(F.lit("S"), "id").alias("standard_id")))


SYNONYMS = [["the", "das", "la"], ["and", "und"], ["of", "de"]]
WORDED = """worded AS (SELECT question_id, question || """ + " || ".join(
    f"CASE WHEN contains(question, '{a}') AND NOT contains(question, '{b}') THEN ' {b}' ELSE '' END" for a, b in sorted((x, y) for g in SYNONYMS for x in g for y in g if x != y)
) + " AS question FROM asked)"


@query(f"""WITH {CORPUS}, open_v AS (SELECT v.* FROM vectors v JOIN standards s USING (standard_id) WHERE s.status = '现行' AND coalesce(s.access_level, 'public') = 'public'),
open_c AS (SELECT c.* FROM clauses c JOIN standards s USING (standard_id) WHERE s.status = '现行' AND coalesce(s.access_level, 'public') = 'public'), {WORDED}, {dense('open_v', 'asked', 'd')}, {bm25('open_c', 'worded', 'b')},
d20 AS (SELECT * FROM d WHERE rank <= 20), b20 AS (SELECT * FROM b WHERE rank <= 20), {rrf({'dense': 'd20', 'bm25': 'b20'}, 'fused')}
SELECT question_id, clause_id, score, sources, rank FROM fused WHERE rank <= 10""")
def expanded_retrieve(spark, sf) -> DataFrame:
    """Questions that name no standard, with synonyms for BM25."""
    vectors, clauses, standards = corpus(spark, sf)
    plain = standards.withColumn("standard_no", F.lit("none"))  # no number is known, and unknown ones stay wide
    q = questions_with_vectors(spark, sf)
    return R.text_retrieve(q, vectors, clauses, plain, path_k=20, k=10, unknown_is_empty=False, synonyms=SYNONYMS).select("question_id", "clause_id", "score", "sources", "rank")


MAKE_ID = "('0x' || substr(sha256({x}), 1, 15))::BIGINT::VARCHAR"


@query(rf"""WITH {DOC_LINES}, heads AS (SELECT doc_id, regexp_extract(line, {HEAD}, 1) AS no FROM folded),
n AS (SELECT doc_id, count(DISTINCT no) FILTER (no <> '') AS n FROM heads GROUP BY doc_id),
own AS (SELECT doc_id, regexp_extract(string_agg(CASE WHEN ln % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN translate((doc_id % 7 + 1) || '.' || (ln // 3 + 1) || '.2', '0123456789.', '０１２３４５６７８９．') ELSE (doc_id % 7 + 1) || '.' || (ln // 3 + 1) || '.2' END || ' ' || line ELSE '  ' || line END, chr(10) ORDER BY ln),
  '[A-Z]{{2,}}(?:/[A-Z]+)?[ \t]*[A-Z]{{0,2}}\d+(?:\.\d+)?-(?:19|20)\d{{2}}', 0) AS no FROM numbered GROUP BY doc_id)
SELECT {MAKE_ID.format(x='doc_id::VARCHAR')} AS standard_id, CASE WHEN own.no <> '' THEN own.no ELSE doc_id::VARCHAR END AS standard_no, nullif(n, 0) AS clause_count, CASE WHEN n = 0 THEN 'no_clauses' ELSE '' END AS issues, n > 0 AS passed FROM n JOIN own USING (doc_id)""")
def ingest_reports(spark, sf) -> DataFrame:
    return I.ingest(clause_pages(spark, sf))["reports"].select("standard_id", "standard_no", "clause_count", F.array_join("issues", ",").alias("issues"), "passed")


def _layouts(spark, sf) -> DataFrame:
    """A heading, a text and a table for each part; the confidence of every tenth size is low."""
    p = table(spark, sf, "part")
    none = F.lit(None).cast("string")
    item = lambda kind, text=none, html=none: F.struct(F.lit(kind).alias("type"), F.col("p_size").cast("int").alias("page_no"), text.alias("text"), html.alias("table_html"), F.when(F.col("p_size") % 10 == 0, 0.5).otherwise(0.9).alias("ocr_confidence"))
    html = F.concat(F.lit("<table><tr><th>a</th><th>b (mm)</th></tr><tr><td>r</td><td>"), "p_size", F.lit("</td></tr></table>"))
    body = F.struct(F.concat(F.lit("/in/f"), "p_partkey", F.lit(".pdf")).alias("source_path"), F.concat("p_name", F.lit(" GB  "), 10000 + F.col("p_partkey"), F.lit("-2015")).alias("title"), F.array(item("Heading", F.concat("p_size", F.lit(".2 "), "p_name")), item("Text", F.concat(F.lit("more "), "p_type")), item("Table", html=html)).alias("elements"))
    return p.select("p_partkey", body["source_path"].alias("source_path"), F.to_json(body).alias("json"))


LAID = f"""laid AS (SELECT p_partkey, {MAKE_ID.format(x="'/in/f' || p_partkey || '.pdf'")} AS standard_id, 'GB ' || (10000 + p_partkey) || '-2015' AS standard_no, 'f' || p_partkey AS name, p_size || '.2' AS no, p_size || '.2 ' || p_name || 'more ' || p_type AS text, p_size % 10 <> 0 AS passed, p_size FROM part)"""


@query(f"""WITH {LAID} SELECT standard_id, standard_no, passed, 1::BIGINT AS n_nodes, passed::BIGINT AS n_chunks, CASE WHEN passed THEN md5(standard_no || ' ' || name || ' ' || no || ' ' || no || ' ' || text) END AS retrieval_md5,
  standard_id || ':T:' || p_size || ':2' AS table_id, standard_id || ':' || no AS owner, p_size::DOUBLE AS cell FROM laid""")
def ingest_layout(spark, sf) -> DataFrame:
    out = I.ingest_layout(_layouts(spark, sf).select("json"))
    chunks = out["chunks"].groupBy("standard_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(F.md5("retrieval_text")).alias("retrieval_md5"))
    nodes = out["tree"].groupBy("standard_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    tables = out["tables"].select("standard_id", "table_id", F.col("node_id").alias("owner")).join(out["cells"].select("table_id", F.col("number_value").alias("cell")), "table_id")
    rows = out["reports"].select("standard_id", "standard_no", "passed").join(nodes, "standard_id").join(chunks, "standard_id", "left").join(tables, "standard_id")
    return rows.withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


@query(f"""WITH {LAID}, sizes AS (SELECT *, p_partkey % 3 <> 0 AS short FROM laid)
SELECT standard_id, CASE WHEN short THEN standard_no ELSE 'f' || p_partkey END AS standard_no, CASE WHEN short THEN no ELSE '7.1.1' END AS clause_no, CASE WHEN short THEN passed ELSE TRUE END AS passed FROM sizes""")
def ingest_routed(spark, sf) -> DataFrame:
    """Files of under 100 bytes a page come from the layout parser, the others from their text."""
    laid = _layouts(spark, sf)
    pages = laid.select(F.col("source_path").alias("doc_path"), F.lit(1).alias("page_no"), F.when(F.col("p_partkey") % 3 != 0, "short").otherwise(F.concat(F.lit("7.1.1 "), F.repeat(F.lit("long text "), 20))).alias("text"))
    out = I.ingest_routed(pages, laid.select("source_path", "json"))
    return out["reports"].select("standard_id", "standard_no", "passed").join(out["tree"].select("standard_id", "clause_no"), "standard_id")


@query("SELECT source AS doc_path, md5(substr(hex(encode(arg_min(text, doc_id))), 1, 1200)) AS sample_md5 FROM documents WHERE doc_id % 50 >= 3 AND regexp_matches(text, '[^ \\t\\r\\n]') GROUP BY source")
def dump_samples(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("source").alias("doc_path"), F.col("doc_id").alias("page_no"), F.when(F.col("doc_id") % 50 < 3, F.lit(" \n\t")).otherwise(F.col("text")).alias("text"))
    return readers.dump_sample(d).select("doc_path", F.md5(F.hex("sample").cast("binary")).alias("sample_md5"))


@query("SELECT vec_id, 2 - vec_id % 3 // 2 AS seq, len(embedding) AS dim, round(embedding[1]::DOUBLE * (2 - vec_id % 3 // 2), 6) AS first_value FROM embeddings")
def vector_upsert(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    batch = lambda rows, k: rows.select(F.col("vec_id").alias("node_id"), F.transform("embedding", lambda x: (x * k).cast("float")).alias("dense"), F.lit(k).alias("seq"))
    kept = readers.vectors(V.upsert(batch(e, 1).unionByName(batch(e.filter("vec_id % 3 <> 2"), 2)), ["node_id"]), 64)
    return kept.select(F.col("node_id").alias("vec_id"), "seq", F.size("dense").cast("long").alias("dim"), F.round(F.col("dense")[0].cast("double"), 6).alias("first_value"))


@query("SELECT vec_id, CASE WHEN vec_id % 9 <> 0 THEN len(embedding) END AS dim, CASE WHEN vec_id % 9 <> 0 THEN round(embedding[64]::DOUBLE, 6) END AS last_value FROM embeddings")
def embedding_responses(spark, sf) -> DataFrame:
    body = F.to_json(F.struct(F.array(F.struct(F.col("embedding"), F.lit(0).alias("index"))).alias("data"), F.lit("m").alias("model")))
    rows = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 9 == 0, F.lit('{"error":"busy"}')).otherwise(body).alias("json"))
    return readers.first_embedding(rows).select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(F.col("embedding")[63].cast("double"), 6).alias("last_value")).withColumn("dim", F.when(F.col("last_value").isNotNull(), F.col("dim")))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 'N' FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT -o_orderkey, 'N' FROM orders WHERE o_orderkey <> 0")
def insert_new(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    rows = o.select("o_orderkey", F.lit("N").alias("o_orderstatus")).unionByName(o.select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))
    return V.insert_new(o.filter("o_orderkey % 4 <> 0"), rows.unionByName(rows), ["o_orderkey"])


@query(rf"""WITH {DOC_LINES} SELECT doc_id::VARCHAR AS doc_path, count(*) AS clause_count FROM folded WHERE regexp_matches(line, {HEAD}) GROUP BY doc_id""")
def clause_counts(spark, sf) -> DataFrame:
    return S.ingest_counts(S.split_clauses(clause_pages(spark, sf)))


@query("""WITH changed AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'revise' WHEN p_partkey % 6 = 1 THEN 'retire' WHEN p_partkey % 6 = 2 THEN 'add' END AS action FROM part)
SELECT 'S' || id AS standard_id, 'GB ' || id AS standard_no, CASE WHEN action IN ('revise', 'retire') THEN '作废' ELSE '现行' END AS status, CASE WHEN action = 'revise' THEN 'N' || id END AS replaced_by FROM changed
UNION ALL SELECT 'N' || id, 'GB ' || id || '-new', '现行', NULL FROM changed WHERE action IN ('revise', 'add')""")
def version_changes(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    action = F.when(k % 6 == 0, "revise").when(k % 6 == 1, "retire").when(k % 6 == 2, "add")
    changes = p.select(F.concat(F.lit("S"), k).alias("standard_id"), action.alias("action"), F.when(action != "retire", F.concat(F.lit("N"), k)).alias("new_id"), F.concat(F.lit("GB "), k, F.lit("-new")).alias("new_no")).filter("action is not null")
    return V.apply_changes(p.select(F.concat(F.lit("S"), k).alias("standard_id"), F.concat(F.lit("GB "), k).alias("standard_no"), F.lit(T.CURRENT).alias("status")), changes)


@query(f"""WITH {HEADINGS}, own AS (SELECT node_id, parent_id FROM tree), hit AS (SELECT node_id FROM own WHERE node_id LIKE '%1')
SELECT node_id, CASE WHEN node_id IN (SELECT node_id FROM hit) THEN 'amended' ELSE 'parent amended' END AS reason FROM own WHERE node_id IN (SELECT node_id FROM hit) OR parent_id IN (SELECT node_id FROM hit)""")
def reindex_nodes(spark, sf) -> DataFrame:
    tree = S.clause_tree(headings(spark, sf))
    return V.reindex(tree, tree.filter("node_id like '%1'").select("node_id"))


@query("""SELECT count(*) AS total, round(avg((l_linenumber % 3 = l_suppkey % 3)::INT), 9) AS version_accuracy, round(avg((l_returnflag = 'R')::INT), 9) AS retired_misuse,
  round(avg(coalesce(l_quantity % 7 = l_linenumber, FALSE)::INT), 9) AS page_hit, round(avg((l_partkey % 4 <> 0)::INT), 9) AS mapping_success FROM lineitem""")
def version_rates(spark, sf) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", T.RETIRED).otherwise(T.CURRENT)
    return E.version_rates(table(spark, sf, "lineitem").select((F.col("l_linenumber") % 3).alias("cited_id"), (F.col("l_suppkey") % 3).alias("gold_id"), status.alias("cited_status"), (F.col("l_quantity") % 7).alias("cited_page"), F.col("l_linenumber").alias("gold_page"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_partkey")).alias("node_id")))


@query("""WITH k AS (SELECT conv_id, turn, text, sha256(text || chr(1) || 'public' || chr(1) || 'v1') AS key FROM conversations), c AS (SELECT key, min('answer ' || conv_id) AS answer FROM k WHERE conv_id % 2 = 0 GROUP BY key)
SELECT conv_id, turn, coalesce(answer, 'to do') AS answer FROM k LEFT JOIN c USING (key)""")
def cache_hits(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    kept = c.filter("conv_id % 2 = 0").select(R.cache_key(F.col("question"), F.lit("public"), F.lit("v1")).alias("cache_key"), F.concat(F.lit("answer "), "conv_id").alias("answer"))
    hits, rest = R.cached(c, kept, F.lit("public"), F.lit("v1"))
    return hits.select("conv_id", "turn", "answer").unionByName(rest.select("conv_id", "turn", F.lit("to do").alias("answer")))


@query(f"""WITH {VECTORS}, asked AS (SELECT vec_id AS question_id, embedding AS query FROM embeddings WHERE vec_id % 20 = 0), {dense('vectors', 'asked', 'a')}, d AS (SELECT * FROM a WHERE rank <= 10), {rrf({'dense': 'd'}, 'f')}
SELECT question_id, clause_id, sources, score, rank FROM f WHERE rank <= 5""")
def rerank_fallback(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    found = R.dense_top_k(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query")), vectors_of(e), 10)
    return R.rerank_or_fused(R.rrf_fuse([("dense", found)], 10), found, None).drop("standard_id")

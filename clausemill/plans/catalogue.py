"""Queries over the test tables, one or more for each operator; the SQL twins are in catalogue_sql."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators import structure as S
from ..operators import versioning as V
from ..session import table
from ..sources import readers
from .catalogue_inputs import (
    answers,
    cells_input,
    clause_pages,
    corpus,
    document_questions,
    headings,
    order_standards,
    line_clauses,
    questions_with_vectors,
    vectors_of,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def dense_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query"))
    return R.dense_top_k(asked, vectors_of(e), 5).select("question_id", "clause_id", "score", "rank")


@query
def dense_filtered_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query"))
    return R.dense_top_k(asked, vectors_of(e), 5, where=F.col("label") % 2 == 0).select("question_id", "clause_id", "score", "rank")


@query
def dense_batch_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query"))
    return R.dense_top_k(asked, vectors_of(e), 5).select("question_id", "clause_id", "score", "rank")


@query
def bm25_topk(spark, sf):
    return R.bm25_top_k(document_questions(spark, sf), corpus(spark, sf)[1], 5).select("question_id", "clause_id", "score", "rank")


@query
def synonym_expand(spark, sf):
    q = table(spark, sf, "conversations").select(F.col("conv_id"), "turn", F.col("text").alias("question"))
    return R.expand_synonyms(q, [["the", "das", "la"], ["and", "und"], ["of", "de"]]).select("conv_id", "turn", "expanded")


@query
def query_analysis(spark, sf):
    c = table(spark, sf, "conversations")
    text = F.concat(F.lit("GB/T "), 50000 + F.col("conv_id"), F.lit("-2019 第"), F.col("turn") + 1, F.lit("."), F.col("conv_id") % 9 + 1, F.lit(".1条 "), F.when(F.col("conv_id") % 3 == 0, F.lit("限值 ")).otherwise(F.lit("")), F.col("text"))
    return R.analyse(c.select(F.concat_ws("/", "conv_id", "turn").alias("question_id"), text.alias("question"))).select("question_id", "standard_no", "clause_no", "wants_table")


@query
def rrf_fuse(spark, sf):
    q = questions_with_vectors(spark, sf)
    vectors, clauses, _ = corpus(spark, sf)
    dense = R.dense_top_k(q, vectors, 20)
    bm25 = R.bm25_top_k(q, clauses, 20)
    return R.rrf_fuse([("dense", dense), ("bm25", bm25)], 10).select("question_id", "clause_id", "score", "sources", "rank")


@query
def text_retrieve(spark, sf):
    vectors, clauses, standards = corpus(spark, sf)
    return R.text_retrieve(questions_with_vectors(spark, sf), vectors, clauses, standards, path_k=20, k=10).select("question_id", "clause_id", "score", "sources", "rank")


@query
def rerank(spark, sf):
    q = questions_with_vectors(spark, sf)
    vectors, clauses, _ = corpus(spark, sf)
    dense, bm25 = R.dense_top_k(q, vectors, 20), R.bm25_top_k(q, clauses, 20)
    return R.rerank(R.rrf_fuse([("dense", dense), ("bm25", bm25)], 20), dense, bm25).select("question_id", "clause_id", "score", "rank")


@query
def exact_lookup(spark, sf):
    asked = table(spark, sf, "events").filter("event_id % 20 = 0").select(F.col("event_id").alias("question_id"), F.concat(F.lit("GB "), 50000 + F.col("event_id") * 7 % 2000, F.lit("-2010")).alias("standard_no"), F.lit("1.1.1").alias("clause_no"))
    return R.exact_lookup(asked, order_standards(spark, sf), line_clauses(spark, sf)).select("question_id", "clause_id", "standard_id")


@query
def clause_split(spark, sf):
    return S.split_clauses(clause_pages(spark, sf)).select("doc_path", "ord", "clause_no", "text")


@query
def element_scan(spark, sf):
    return S.line_elements(clause_pages(spark, sf)).filter("type = 'Heading'").select("doc_path", "ord", "clause_no", "level", "title", F.length("text").alias("n_chars"))


@query
def standard_no(spark, sf):
    p = table(spark, sf, "part")
    text = F.when(F.col("p_partkey") % 5 != 0, F.concat("p_name", F.lit(" GB "), 50000 + F.col("p_partkey"), F.lit("-"), 1990 + F.col("p_size") % 30)).otherwise(F.col("p_name"))
    path = F.concat(F.lit("/in/"), "p_brand", F.lit("/file."), "p_partkey", F.lit(".pdf"))
    return p.select("p_partkey", T.extract_standard_no(text, T.stem(path)).alias("standard_no"), T.filename(path).alias("file_name"), T.is_pdf(path).alias("is_pdf"))


@query
def standard_normalize(spark, sf):
    raw = F.concat(F.lit("  "), F.when(F.col("p_partkey") % 2 == 0, "GB/T").otherwise("JTG"), F.when(F.col("p_partkey") % 3 == 0, "   ").otherwise(""), F.col("p_partkey") + 10000, F.lit("-"), 1990 + F.col("p_size") % 30, F.lit(" "))
    return table(spark, sf, "part").select("p_partkey", T.normalize_standard_no(raw).alias("standard_no"), T.is_valid_clause_no(F.concat(F.col("p_size"), F.lit(".1"))).alias("valid"))


def _order_batches(spark, sf):
    o = table(spark, sf, "orders")
    first = o.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"), F.lit(1).alias("seq"))
    second = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit(T.CURRENT).alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("price"), F.lit(2).alias("seq"))
    return first.unionByName(second)


@query
def standard_upsert(spark, sf):
    return V.upsert(_order_batches(spark, sf), ["o_orderkey"]).select("o_orderkey", "o_orderstatus", F.round("price", 2).alias("price"))


@query
def clause_upsert(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat_ws(":", "l_orderkey", F.col("l_linenumber") % 3).alias("node_id"), F.concat(F.lit("t"), "l_partkey").alias("text"), F.col("l_linenumber").alias("page_start"), F.concat(F.lit("h"), "l_suppkey").alias("title"), ((F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")).alias("seq"))
    return V.partial_upsert(rows, ["node_id"], ["text"], ["title", "page_start"])


@query
def review_status(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("standard_id"), F.lit("new").alias("review_status"))
    gate = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("standard_id")).agg((F.count(F.lit(1)) > 3).alias("passed"))
    return V.set_review_status(o, gate)


@query
def orphan_check(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    o = table(spark, sf, "orders").filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return V.orphans(l, o, "l_orderkey")


@query
def clause_tree(spark, sf):
    return S.clause_tree(headings(spark, sf)).select("node_id", "parent_id", "node_type", "path", F.col("level").cast("long").alias("level"), "page_start", "title", F.md5("text").alias("text_md5"))


@query
def chunk_build(spark, sf):
    standards = spark.range(3).select(F.concat(F.lit("S"), "id").alias("standard_id"), F.concat(F.lit("GB "), 50000 + F.col("id"), F.lit("-2015")).alias("standard_no"), F.concat(F.lit("name"), "id").alias("standard_name"))
    return S.build_chunks(S.clause_tree(headings(spark, sf)), standards).select("chunk_id", "chunk_type", F.md5("retrieval_text").alias("retrieval_md5"), F.md5("context_text").alias("context_md5"))


@query
def page_map(spark, sf):
    return S.page_map(S.clause_tree(headings(spark, sf)))


@query
def table_cells(spark, sf):
    return S.table_cells(S.structure_tables(cells_input(spark, sf))).withColumn("number_value", F.coalesce("number_value", F.lit(-1.0)))


@query
def table_markdown(spark, sf):
    return S.structure_tables(cells_input(spark, sf)).select("table_id", "table_markdown")


@query
def table_owner(spark, sf):
    tree = S.clause_tree(headings(spark, sf))
    tables = table(spark, sf, "part").select(F.concat(F.lit("S"), F.col("p_partkey") % 4).alias("standard_id"), (F.col("p_size") % 9).alias("page_no"), "p_partkey")
    return S.table_owner(tables, tree).select("p_partkey", "node_id")


@query
def parser_route(spark, sf):
    p = table(spark, sf, "pages").withColumn("host", F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)).withColumn("text", F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.col("html")))
    return S.parser_route(p.withColumn("parity", F.col("page_id") % 4), ["host", "parity"], F.col("parity") < 3)


@query
def quality_gate(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    r = d.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("clause_count"), F.avg(F.coalesce("quality", F.lit(1))).alias("avg_ocr_confidence"))
    r = r.withColumn("standard_no", F.when(F.col("docs") % 7 == 0, F.lit("")).otherwise(F.col("source")))
    return S.quality_gate(r).select("source", F.array_join("issues", ",").alias("issues"), "passed")


@query
def context_fragments(spark, sf):
    vectors, clauses, standards = corpus(spark, sf)
    found = R.dense_top_k(questions_with_vectors(spark, sf), vectors, 5)
    rows = C.fragments(found, clauses.filter("clause_id not like '%3'"), standards.filter("standard_id <> 'S7'"))
    return C.context_json(rows.withColumn("text", F.md5("text"))).select("question_id", "n_fragments", "context")


@query
def prompts(spark, sf):
    vectors, clauses, standards = corpus(spark, sf)
    q = questions_with_vectors(spark, sf)
    found = R.dense_top_k(q, vectors, 5).filter("question_id > 0")
    rows = C.fragments(found, clauses.filter("clause_id not like '%3' and clause_id <> 'D1'"), standards)
    asked = C.prompts(q, found, C.context_json(rows.filter("question_id % 60 <> 40")))
    return asked.select("question_id", F.col("user_prompt").isNotNull().alias("asks"), F.coalesce("refusal", F.lit("")).alias("refusal"))


@query
def small_to_big(spark, sf):
    vectors, clauses, standards = corpus(spark, sf)
    rows = C.fragments(R.dense_top_k(questions_with_vectors(spark, sf), vectors, 5), clauses, standards)
    chunks = clauses.filter("cast(substring(clause_id, 2) as long) % 2 = 0").select(F.concat("clause_id", F.lit("#c")).alias("chunk_id"), F.col("clause_id").alias("node_id"), F.concat(F.lit("ctx "), "clause_no").alias("context_text"))
    return C.small_to_big(rows, chunks).select("question_id", "source_id", F.md5("text").alias("text_md5"))


@query
def numeric_verify(spark, sf):
    a = answers(spark, sf)
    bad = T.unverified_numbers(F.col("answer"), F.col("source"))
    return a.select("conv_id", "turn", F.size(T.numbers(F.col("answer"))).cast("long").alias("n_numbers"), F.array_join(F.transform(bad, lambda x: x["raw"]), ";").alias("unverified"))


@query
def numeric_intercept(spark, sf):
    a = answers(spark, sf)
    rows = a.select(F.concat_ws("/", "conv_id", "turn").alias("question_id"), F.lit(1).alias("ord"), F.col("source").alias("text"), F.lit("4.2.1").alias("clause_no"), F.lit("JTG D60-2015").alias("standard_no"))
    out = C.intercept_numbers(a.select(F.concat_ws("/", "conv_id", "turn").alias("question_id"), "answer"), rows)
    return out.select("question_id", "all_verified", F.md5("final").alias("final_md5"))


@query
def citation_refusal(spark, sf):
    a = answers(spark, sf)
    return a.select("conv_id", "turn", T.cites_clause(F.col("answer"), F.col("gold")).alias("cited"), T.cites_clause(F.col("answer"), F.col("gold"), strict=True).alias("cited_strict"), T.is_refusal(F.col("answer")).alias("refused"), T.refusal_correct(F.col("should_answer"), T.is_refusal(F.col("answer"))).alias("refusal_ok"))


def _cases(spark, sf):
    e = table(spark, sf, "embeddings")
    vectors = vectors_of(e)
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query"))
    ranked = E.ranked_lists(R.dense_top_k(asked, vectors, 10))
    gold = e.groupBy("label").agg(F.concat(F.lit("D"), F.min("vec_id")).alias("gold"))
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "label").join(gold, "label").join(ranked, "question_id")


@query
def retrieval_metrics(spark, sf):
    return E.retrieval_metrics(_cases(spark, sf)).select("question_id", "recall_3", "hit_1", F.round("rr", 9).alias("rr"))


@query
def eval_summary(spark, sf):
    cases = E.retrieval_metrics(_cases(spark, sf)).withColumn("gold", F.when(F.expr("question_id div 20") % 5 != 0, F.col("gold"))).withColumn("should_answer", F.expr("question_id div 20") % 4 != 0).withColumn("must_cite", F.expr("question_id div 20") % 2 == 0).withColumn("cited", F.expr("question_id div 20") % 3 == 0).withColumn("refusal_ok", F.expr("question_id div 20") % 7 != 0)
    return E.summary(cases)


@query
def ab_compare(spark, sf):
    m = E.retrieval_metrics(_cases(spark, sf)).withColumn("variant", F.when(F.expr("question_id div 20") % 2 == 0, "a").otherwise("b"))
    return E.compare(m, ["recall_3", "rr"], "a", "b")


@query
def threshold_calib(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.round(F.col("n_chars") % 997 / 997.0 + F.col("quality") * 0.3, 3).alias("top_score"), (F.col("quality") == 1).alias("should_answer"))
    return E.calibrate(d).select(F.round("threshold", 9).alias("threshold"), F.round("false_refusal_rate", 9).alias("false_refusal_rate"), F.round("wrong_answer_rate", 9).alias("wrong_answer_rate"))


@query
def access_guard(spark, sf):
    _, clauses, standards = corpus(spark, sf)
    own = clauses.withColumn("status", F.when(F.col("clause_id").like("%9"), T.REVISED).otherwise(T.CURRENT))
    return R.authority_guard(clauses.select("clause_id", "standard_id"), standards, own).select("clause_id", "effective_status")


@query
def reference_expand(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("clause_id"), "o_orderstatus")
    hits = o.select((F.col("clause_id") % 5).alias("question_id"), "clause_id")
    refs = o.select("clause_id", F.explode(F.array(F.col("clause_id") - 1, F.col("clause_id"), F.col("clause_id") + 1)).alias("target_id"))
    admitted = o.select("clause_id", F.when(F.col("o_orderstatus") == "F", T.RETIRED).otherwise(T.CURRENT).alias("status"))
    aux, warnings = V.expand_references(hits, refs, admitted)
    return aux.select("question_id", "clause_id", F.lit("aux").alias("kind")).unionByName(warnings.select("question_id", "clause_id", F.lit("warning").alias("kind")))


@query
def cell_locator(spark, sf):
    s = S.structure_tables(cells_input(spark, sf))
    cells = S.table_cells(s)
    asked = table(spark, sf, "part").select(F.col("p_partkey").alias("question_id"), F.concat_ws(":", F.lit("S"), F.lit("T"), F.col("p_size"), F.col("p_partkey")).alias("table_id"), F.when(F.col("p_partkey") % 3 == 0, "retail").when(F.col("p_partkey") % 3 == 1, "size").otherwise("none").alias("row_header"), F.lit("value (mm)").alias("col_header"), F.when(F.col("p_partkey") % 2 == 0, "mm").otherwise("").alias("unit"))
    return V.locate_cells(asked, cells, s).select("question_id", "n_cells", "answer")


@query
def token_budget(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") % 10).alias("question_id"), (F.col("doc_id") % 4 + 1).alias("priority"), F.col("doc_id").alias("ord"), "text")
    return C.budget(d, 60_000).select("question_id", "ord", "running")


@query
def version_chain(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("standard_id"), F.expr("date_add(date'2000-01-01', cast(p_partkey * 13 % 9000 as int))").alias("effective"))
    return V.version_chain(p, F.expr("date'2015-06-30'")).select("standard_id", "status", F.coalesce("replaces", F.lit(-1)).alias("replaces"), F.coalesce("replaced_by", F.lit(-1)).alias("replaced_by"))


@query
def supersede(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("clause_id"), "p_name")
    amended = table(spark, sf, "part").filter("p_partkey % 6 = 0").select((F.col("p_partkey") - 1).alias("supersedes"), F.col("p_brand").alias("revision_source"), F.when(F.col("p_size") % 2 == 0, T.CURRENT).otherwise(T.RETIRED).alias("status"))
    return V.supersede(p, amended, include_history=True).select("clause_id", "revised", "revision_source")


@query
def reconcile(spark, sf):
    o = table(spark, sf, "orders")
    truth = o.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("node_id"), F.col("o_orderstatus").alias("status"))
    index = o.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("node_id"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("status"))
    return V.reconcile(truth, index, "node_id", ["status"])


@query
def metadata_enrich(spark, sf):
    p = table(spark, sf, "part")
    chunks = p.select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("retrieval_text"))
    meta = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("node_id"), F.array("p_type", "p_brand").alias("keywords"), F.array(F.concat(F.lit("what is "), "p_name")).alias("common_questions"))
    return V.enrich(chunks, meta)


@query
def visual_page_recall(spark, sf):
    e = table(spark, sf, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query"))
    pages = e.select(F.concat(F.lit("P"), "vec_id").alias("page_id"), F.col("embedding").alias("dense"))
    mapped = e.select(F.concat(F.lit("P"), "vec_id").alias("page_id"), F.concat(F.lit("C"), F.col("vec_id") % 60).alias("clause_id"))
    return R.visual_recall(asked, pages, mapped, 30, 5).select("question_id", "clause_id", "score", "pages", "rank")


@query
def block_clauses(spark, sf):
    l = table(spark, sf, "lineitem")
    blocks = l.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("block_id"), F.col("l_suppkey").alias("standard_id"), F.col("l_linenumber").alias("page_no"), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("N"), "l_partkey")).alias("related_node_id"), F.when(F.col("l_partkey") % 11 != 0, F.col("l_discount") * 10).alias("quality_score"))
    mapped = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("standard_id"), (F.col("s_suppkey") % 7 + 1).cast("int").alias("page_no"), F.concat(F.lit("M"), "s_suppkey").alias("node_id"))
    return V.block_clauses(V.filter_blocks(blocks, 0.3), mapped)


@query
def mode_router(spark, sf):
    c = table(spark, sf, "conversations")
    lead = F.when(F.col("conv_id") % 6 == 0, "GB 50010-2010 ").when(F.col("conv_id") % 6 == 1, "表 ").when(F.col("conv_id") % 6 == 2, "第3页 ").when(F.col("conv_id") % 6 == 3, "流程图 ").otherwise("")
    q = c.select(F.concat_ws("/", "conv_id", "turn").alias("question_id"), F.concat(lead, F.col("text")).alias("question"), (F.col("turn") / 7.0).alias("confidence"))
    return R.route_mode(R.analyse(q).join(q.select("question_id", "confidence"), "question_id"), text_confidence=F.col("confidence")).select("question_id", "mode")


@query
def cross_modal_fuse(spark, sf):
    e = table(spark, sf, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query"))
    text = R.dense_top_k(asked, vectors_of(e).filter("label < 6"), 10)
    visual = R.dense_top_k(asked, vectors_of(e).filter("label > 3"), 10)
    return R.cross_modal_fuse(text, visual, 5).select("question_id", "clause_id", "score", "sources", "rank")


@query
def degrade(spark, sf):
    vectors, clauses, _ = corpus(spark, sf)
    q = questions_with_vectors(spark, sf)
    return R.degrade({"dense": None, "bm25": R.bm25_top_k(q, clauses, 10)}, 5)[0].select("question_id", "clause_id", "sources", "rank")


@query
def cache_keys(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", R.cache_key(F.col("text"), F.when(F.col("turn") % 2 == 0, "public").otherwise("internal"), F.lit("v1")).alias("cache_key"))


@query
def doc_dump_stats(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("doc_path"), F.col("doc_id").alias("page_no"), F.when(F.col("doc_id") % 50 < 3, F.lit(" \n\t")).otherwise(F.col("text")).alias("text"))
    return readers.dump_stats(d)


@query
def layout_elements(spark, sf):
    p = table(spark, sf, "part")
    item = lambda t, page, text: F.struct(F.lit(t).alias("type"), page.alias("page_no"), text.alias("text"))
    doc = F.to_json(F.struct(F.concat(F.lit("f"), "p_partkey").alias("source_path"), F.col("p_name").alias("title"), F.array(item("Heading", F.col("p_size"), F.concat(F.col("p_size"), F.lit(".2 "), "p_name")), item("Odd", F.col("p_size") + 1, F.col("p_type"))).alias("elements")))
    return readers.layout_elements(p.select(doc.alias("json"))).select("source_path", F.col("ord").cast("long").alias("ord"), "type", "page_no", "clause_no", "text")

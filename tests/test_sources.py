import json

import pytest

import __spark_entry__ as entry
from clausemill.plans.ingest import ingest
from clausemill.session import table
from clausemill.sources import readers
from clausemill.sources.config import Config
from clausemill.streaming.ingest import ingest_stream, read_clauses


def test_config():
    c = Config.from_map({"RAG_PG_CONNINFO": "x", "RAG_EMBED_KEY": "k", "RAG_DEEPSEEK_KEY": "d", "RAG_DOC_PATH": "p"})
    assert c.missing_required() == [] and c.embed_dim == 4096 and c.milvus_collection == "clause_text" and c.doc_path == "p"
    assert len(Config.from_map({}).missing_required()) == 3
    assert Config.from_json('{"RAG_EMBED_DIM": "2048"}').embed_dim == 2048 and Config.from_json('{"RAG_EMBED_DIM": 1024, "RAG_EMBED_KEY": null}').embed_dim == 1024
    assert len(Config.from_json("{nope").missing_required()) == 3 and len(Config.from_file("/nonexistent").missing_required()) == 3


def test_layout_json(spark):
    doc = json.dumps({"source_path": "p", "title": "t", "elements": [{"type": "Heading", "page_no": 1, "level": 1, "text": "4.2 Scope"}, {"type": "Table", "table_html": "<tr></tr>"}, {"type": "Odd", "text": "x"}]})
    rows = readers.layout_elements(spark.createDataFrame([(doc,)], "json string")).orderBy("ord").collect()
    assert [(r.type, r.clause_no) for r in rows] == [("Heading", "4.2"), ("Table", ""), ("Text", "")]
    with pytest.raises(Exception, match="layout parser"):
        readers.layout_elements(spark.createDataFrame([('{"error": "bad"}',)], "json string")).collect()
    items = json.dumps([{"type": "text", "text": "h", "text_level": 1, "page_idx": 0}, {"type": "table", "table_body": "<tr>", "page_idx": 2}, {"type": "image"}])
    rows = readers.content_list(spark.createDataFrame([("d", items)], "doc_path string, json string")).collect()
    assert [(r.type, r.page_no) for r in rows] == [("Heading", 1), ("Table", 3)]


def test_dictionaries():
    assert readers.synonym_groups(["a, b ,c", "# no", "", " x,"]) == [["a", "b", "c"], ["x"]]
    assert readers.user_terms([" t ", "#c", ""]) == ["t"]


def test_eval_defaults_and_vectors(spark, tmp_path):
    (tmp_path / "e.json").write_text('[{"question": "q"}, {"question": "r", "should_answer": false, "must_cite": true}]')
    rows = readers.eval_cases(spark, str(tmp_path / "e.json")).collect()
    assert [(r.question, r.must_cite, r.should_answer, r.gold_answer) for r in rows] == [("q", False, True, ""), ("r", True, False, "")]
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 2.0])], "node_id string, dense array<float>")
    assert readers.vectors(v, 2).count() == 1
    with pytest.raises(Exception, match="dimension 2"):
        readers.vectors(v, 3).collect()
    r = readers.first_embedding(spark.createDataFrame([('{"data":[{"embedding":[0.5,1.0,2.0],"index":0}]}',)], "json string")).first()
    assert list(r.embedding) == [0.5, 1.0, 2.0]


def test_pages_and_dump(spark, tmp_path):
    (tmp_path / "JTG.txt").write_text("page one\fpage two")
    rows = readers.text_pages(spark, str(tmp_path / "JTG.txt")).orderBy("page_no").collect()
    assert [(r.title, r.page_no, r.text) for r in rows] == [("JTG.txt", 1, "page one"), ("JTG.txt", 2, "page two")]
    pdf = readers.pdf_pages(spark, str(tmp_path / "JTG.txt"), lambda data: data.decode().split("\f"))
    assert pdf.count() == 2
    d = spark.createDataFrame([("d", 1, " \n"), ("d", 2, "é")], "doc_path string, page_no int, text string")
    assert tuple(readers.dump_stats(d).first()) == ("d", 2, 4, 2)
    assert readers.dump_lines(d).orderBy("page_no").first().value == "===== 第 1 页 =====\n \n"


def test_ingest_plan(spark):
    pages = spark.createDataFrame([("/x/JTG.pdf", 1, "公路 JTG D60-2015\n1.0.1 first\nmore"), ("/x/JTG.pdf", 2, "1.0.2 second"), ("/x/empty.pdf", 1, None)], "doc_path string, page_no int, text string")
    out = ingest(pages)
    s = {r.standard_name: r.standard_no for r in out["standards"].collect()}
    assert s == {"JTG": "JTG D60-2015", "empty": "empty"}
    assert out["clauses"].count() == 2 and out["chunks"].count() == 2 and {r.passed for r in out["reports"].collect()} == {True, False}


def test_stream(spark, tmp_path):
    pages = lambda rows: spark.createDataFrame(rows, "doc_path string, page_no int, text string")
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    pages([("d", 1, "1.1 old"), ("d", 3, "1.2 x")]).write.parquet(src)
    ingest_stream(spark, src, out, cp).awaitTermination()
    pages([("d", 2, "1.1 new")]).write.mode("append").parquet(src)
    ingest_stream(spark, src, out, cp).awaitTermination()
    assert {(r.clause_no, r.text, r.page_start) for r in read_clauses(spark, out).collect()} == {("1.1", "new", 1), ("1.2", "x", 3)}


def test_entry_and_registration(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names)
    assert entry.entry(spark).count() > 0
    assert table(spark, "/root/testdata/sf0.001", "region").count() == 5

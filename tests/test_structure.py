import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.operators import structure as S


def split(spark, lines, page=1):
    pages = spark.createDataFrame([("d", page, "\n".join(lines))], "doc_path string, page_no int, text string")
    return [(r.clause_no, r.text, r.page_start) for r in S.split_clauses(pages).orderBy("ord").collect()]


@pytest.mark.parametrize(
    ("lines", "numbers"),
    [
        (["4.2.1 a", "4.2.2 b", "4.3.1 c"], ["4.2.1", "4.2.2", "4.3.1"]),
        (["preface", "more", "1.0.1 first"], ["1.0.1"]),
        (["4.2.1　a", "4.2.2　b"], ["4.2.1", "4.2.2"]),
        (["4.2.1.1 a", "4.2.1.2 b"], ["4.2.1.1", "4.2.1.2"]),
        (["４.２.１ a"], ["4.2.1"]),
        (["４．２．１ a"], ["4.2.1"]),
        (["4 总则", "2 100 200", "3 术语"], []),
        (["4.2.1.1-a x"], ["4.2.1.1-a"]),
        ([""], []),
    ],
)
def test_heads(spark, lines, numbers):
    assert [x[0] for x in split(spark, lines, 7)] == numbers


def test_continuation_is_joined_and_pages_do_not_carry_over(spark):
    assert split(spark, ["4.2.1 a", "  \tmore", "", "4.2.2 b"], 5) == [("4.2.1", "amore", 5), ("4.2.2", "b", 5)]
    pages = spark.createDataFrame([("d", 1, "1.1 a\r\nb"), ("d", 2, "carried\n1.2 c"), ("d", 3, None)], "doc_path string, page_no int, text string")
    assert sorted((r.clause_no, r.text, r.page_start) for r in S.split_clauses(pages).collect()) == [("1.1", "ab", 1), ("1.2", "c", 2)]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "number"),
    [("公路 JTG D60-2015\n通用", "JTG D60-2015"), ("GB 50010-2010 设计", "GB 50010-2010"), ("GB/T 50081-2019 x", "GB/T 50081-2019"), ("none", "stem"), ("按 TB 10002-2017 执行", "TB 10002-2017"), ("JTG/T D70-2010", "JTG/T D70-2010")],
)
def test_standard_no(spark, text, number):
    assert one(spark, T.extract_standard_no(F.col("t"), F.lit("stem")), t=text) == number


@pytest.mark.parametrize(("raw", "out"), [("JTGD60-2015", "JTG D60-2015"), ("  GB/T  50081-2019 ", "GB/T 50081-2019"), ("JTG/T D60", "JTG/T D60")])
def test_normalise(spark, raw, out):
    assert one(spark, T.normalize_standard_no(F.col("t")), t=raw) == out


def test_clause_no_validity(spark):
    rows = spark.createDataFrame([("4.2.1",), ("4.2.1-1",), ("1.0.1",), ("第四条",), ("abc",)], "n string").select(T.is_valid_clause_no(F.col("n")).alias("v")).collect()
    assert [r.v for r in rows] == [True, True, True, False, False]


def test_paths(spark):
    rows = spark.createDataFrame([("a/b.c.pdf",), ("x\\y.PDF",), (".env",), ("plain",)], "p string").select(T.filename(F.col("p")).alias("f"), T.stem(F.col("p")).alias("s"), T.is_pdf(F.col("p")).alias("i")).collect()
    assert [tuple(r) for r in rows] == [("b.c.pdf", "b.c", True), ("y.PDF", "y", True), (".env", ".env", False), ("plain", "plain", False)]


def tree(spark, rows):
    return S.clause_tree(spark.createDataFrame(rows, "standard_id string, ord int, clause_no string, title string, text string, page_no int"))


def test_tree_and_chunks(spark):
    t = tree(spark, [("STD1", 1, "4", "c", "four", 10), ("STD1", 2, "4.2", "s", "fourtwo", 11), ("STD1", 3, "4.2.1", "x", "a", 11), ("STD1", 4, "4.2.2", "y", "b", 12), ("STD1", 5, "4.2.1", "x2", "+", 13), ("STD1", 6, "", "", "no", 1), ("STD9", 1, "1.0.1", "", "z", 1), ("STD1", 7, "4.2.1-1", "i", "it", 12)])
    by = {r.node_id: r for r in t.collect()}
    assert by["STD1:4"].node_type == "chapter" and by["STD1:4.2.1"].node_type == "clause" and by["STD1:4.2.1-1"].node_type == "item"
    assert (by["STD1:4.2.1"].parent_id, by["STD1:4.2.1"].path, by["STD1:4.2.1"].page_start, by["STD1:4.2.1"].text, by["STD1:4.2.1"].title) == ("STD1:4.2", "4 / 4.2 / 4.2.1", 11, "a+", "x")
    assert (by["STD9:1.0.1"].parent_id, by["STD9:1.0.1"].path, by["STD9:1.0.1"].level) == ("", "1.0.1", 1)
    assert by["STD1:4.2.1-1"].parent_id == "STD1:4.2" and len(by) == 6
    chunks = {r.chunk_id: r for r in S.build_chunks(t, spark.createDataFrame([("STD1", "GB 1-2000", "name")], "standard_id string, standard_no string, standard_name string")).collect()}
    c = chunks["STD1:4.2.1#clause"]
    assert c.atomic_text == "a+" and c.context_text == "fourtwo" and c.retrieval_text == "GB 1-2000 name 4 / 4.2 / 4.2.1 4.2.1 a+"
    assert "STD1:4#chapter" not in chunks and chunks["STD9:1.0.1#clause"].context_text == "z"
    pages = S.page_map(t).filter("page_no = 11").collect()
    assert len(pages) == 2 and {r.coverage_type for r in pages} == {"full"}
    owner = S.table_owner(spark.createDataFrame([("STD1", 11), ("STD1", 99)], "standard_id string, page_no int"), t).collect()
    assert {(r.page_no, r.node_id) for r in owner} == {(11, "STD1:4.2"), (99, "STD1")}


def test_tables(spark):
    html = "<table><tr><th>等级</th><th>压实度(%)</th></tr><tr><td>高速</td><td>96</td></tr>\n<TR\nclass=x><td>一级</td><td> <b>95</b> </td></TR></table>"
    t = spark.createDataFrame([("STD1", 12, 0, html), ("STD1", 12, 1, "<tr><td>a</td></tr><tr><td>b</td></tr>"), ("STD1", 12, 2, None)], "standard_id string, page_no int, table_index int, html string")
    s = S.structure_tables(t)
    cells = S.table_cells(s).orderBy("row_idx").collect()
    assert [(c.table_id, c.row_idx, c.col_idx, c.row_header, c.col_header, c.cell_text, c.number_value, c.unit) for c in cells] == [("STD1:T:12:0", 1, 1, "高速", "压实度(%)", "96", 96.0, "%"), ("STD1:T:12:0", 2, 1, "一级", "压实度(%)", "95", 95.0, "%")]
    assert s.filter("table_index = 0").first().table_markdown == "| 等级 | 压实度(%) |\n|---|---|\n| 高速 | 96 |\n| 一级 | 95 |"


def test_gate_and_route(spark):
    r = S.quality_gate(spark.createDataFrame([("a", 5, 0.9), ("", 5, 0.9), ("a", 0, 0.9), ("a", 5, 0.5)], "standard_no string, clause_count int, avg_ocr_confidence double")).collect()
    assert [x.issues for x in r] == [[], ["standard_no_missing"], ["no_clauses"], ["low_ocr_confidence"]] and [x.passed for x in r] == [True, False, False, False]
    pages = spark.createDataFrame([("a.pdf", "x" * 800), ("b.pdf", "x" * 20), ("c.doc", "x" * 900), ("d.pdf", "x" * 100)], "f string, text string")
    assert {x.f: x.route for x in S.parser_route(pages, ["f"], T.is_pdf(F.col("f"))).collect()} == {"a.pdf": "text", "b.pdf": "layout", "c.doc": "layout", "d.pdf": "text"}


def test_elements_continue_across_pages(spark):
    pages = spark.createDataFrame([("d", 1, "第1章 总则\n1.0.1 text"), ("d", 2, "more\n2 100 200")], "doc_path string, page_no int, text string")
    assert [(r.clause_no, r.level, r.text) for r in S.line_elements(pages).orderBy("ord").collect()] == [("1", 1, "总则"), ("1.0.1", 3, "textmore2 100 200")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(["1.2 a", "x", "", "3.4.5 b", "7 c"]), max_size=12))
def test_one_clause_for_each_head(spark, lines):
    assert len(split(spark, lines)) == sum(x[:1].isdigit() and "." in x.split()[0] for x in lines if x)

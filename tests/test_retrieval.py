import pytest
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.operators import context as C
from clausemill.operators import evaluation as E
from clausemill.operators import retrieval as R
from clausemill.operators import versioning as V

LIST = "question_id int, clause_id string, standard_id string, rank int"


def lists(spark):
    return [("dense", spark.createDataFrame([(1, "4.2.1", "S", 1), (1, "4.3.1", "S", 2)], LIST)), ("bm25", spark.createDataFrame([(1, "4.3.1", "S", 1), (1, "1.0.1", "S", 2)], LIST))]


def test_rrf(spark):
    rows = R.rrf_fuse(lists(spark), 10).orderBy("rank").collect()
    assert [(r.clause_id, r.score, r.sources) for r in rows] == [("4.3.1", round(1 / 61 + 1 / 62, 9), "dense+bm25"), ("4.2.1", round(1 / 61, 9), "dense"), ("1.0.1", round(1 / 62, 9), "bm25")]
    assert R.rrf_fuse(lists(spark), 2).count() == 2
    assert {(r.clause_id, r.score) for r in R.rrf_fuse(lists(spark)[::-1], 10).collect()} == {(r.clause_id, r.score) for r in rows}


def test_dense_filters_before_scoring_and_breaks_ties_by_id(spark):
    v = spark.createDataFrame([("b", "S", [1.0, 0.0], "现行"), ("a", "S", [2.0, 0.0], "现行"), ("c", "S", [0.0, 1.0], "现行"), ("d", "S", [1.0, 0.0], "作废")], "clause_id string, standard_id string, dense array<float>, status string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "question_id int, query array<float>")
    out = R.dense_top_k(q, v, 2, where=F.col("status") == "现行")
    assert [(r.clause_id, r.score) for r in out.orderBy("rank").collect()] == [("a", 1.0), ("b", 1.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan


def test_bm25_prefers_rare_terms(spark):
    c = spark.createDataFrame([("a", "S", "alpha beta beta"), ("b", "S", "beta gamma"), ("c", "S", "压实度标准"), ("d", "S", None)], "clause_id string, standard_id string, text string")
    q = spark.createDataFrame([(1, "alpha Beta"), (2, "压实度"), (3, "zzz")], "question_id int, question string")
    rows = R.bm25_top_k(q, c, 5).collect()
    assert {(r.question_id, r.clause_id) for r in rows if r.rank == 1} == {(1, "a"), (2, "c")}


def test_analysis(spark):
    q = spark.createDataFrame([(1, "JTG D60-2015 第4.2.1.1条"), (2, "压实度限值是多少"), (3, "plain question")], "question_id int, question string")
    rows = {r.question_id: r for r in R.analyse(q).collect()}
    assert (rows[1].standard_no, rows[1].clause_no) == ("JTG D60-2015", "4.2.1.1")
    assert rows[2].wants_table and rows[2].standard_no == "" and rows[2].clause_no == ""
    assert rows[3].clean_text == "plain question" and not rows[3].wants_table


def test_synonyms(spark):
    q = spark.createDataFrame([(1, "a x"), (2, "none"), (3, "a b c")], "question_id int, question string")
    out = {r.question_id: r.expanded for r in R.expand_synonyms(q, [["a ", "bb"], ["x", "y", "w"]]).collect()}
    assert out == {1: "a x bb w y", 2: "none", 3: "a b c bb"}


def test_large_dictionaries(spark):
    groups = [[f"term{k}x", f"word{k}x"] for k in range(2000)]
    q = spark.createDataFrame([(1, "a term7x and word1999x"), (2, "none")], "question_id int, question string")
    assert {r.question_id: r.expanded for r in R.expand_synonyms(q, groups).collect()} == {1: "a term7x and word1999x word7x term1999x", 2: "none"}


def test_kept_index_gives_the_same(spark, tmp_path):
    c = spark.createDataFrame([("a", "S", "alpha beta beta"), ("b", "S", "beta gamma"), ("c", "S", "gamma delta"), ("d", "S", None), ("e", "S", "")], "clause_id string, standard_id string, text string")
    q = spark.createDataFrame([(1, "alpha Beta"), (2, "gamma"), (3, "zzz"), (4, "")], "question_id int, question string")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS kept LOCATION '{tmp_path}'")
    try:
        R.keep_index(c.limit(1), "kept.postings", buckets=4)
        R.keep_index(c, "kept.postings", buckets=4)  # drops the older one
        index = R.kept_index(spark, "kept.postings")
        rows = lambda df: sorted(map(tuple, df.collect()))
        assert rows(R.bm25_top_k(q, None, 5, index=index)) == rows(R.bm25_top_k(q, c, 5)) != []
        plan = index.groupBy("token").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.sql("DROP DATABASE kept CASCADE")


def test_citations_of_odd_numbers(spark):
    rows = spark.createDataFrame([("see (4.2", "(4.2"), ("see 4x2", "4.2"), ("a[b]c 1", "[b]"), ("x", "")], "answer string, no string")
    assert [r.c for r in rows.select(T.cites_clause(F.col("answer"), F.col("no")).alias("c")).collect()] == [True, False, True, False]


def test_scalar_filter_skips_access_for_admin(spark):
    s = spark.createDataFrame([("1", "现行", "public"), ("2", "现行", "internal"), ("3", "作废", "public"), ("4", "现行", None)], "standard_id string, status string, access_level string")
    ids = lambda c: {r.standard_id for r in s.filter(c).collect()}
    assert ids(R.scalar_filter()) == {"1", "4"} and ids(R.scalar_filter(access="admin")) == {"1", "2", "4"} and ids(R.scalar_filter(standard_id="1")) == {"1"}


def test_exact_needs_both_unless_told(spark):
    a = spark.createDataFrame([(1, "GB 1-2000", "1.1"), (2, "", "1.1"), (3, "GB 1-2000", "")], "question_id int, standard_no string, clause_no string")
    s = spark.createDataFrame([("S1", "GB 1-2000", "作废"), ("S2", "GB 1-2000", "现行")], "standard_id string, standard_no string, status string")
    c = spark.createDataFrame([("S1", "1.1", "S1:1.1"), ("S2", "1.1", "S2:1.1")], "standard_id string, clause_no string, clause_id string")
    assert [(r.question_id, r.clause_id) for r in R.exact_lookup(a, s, c).collect()] == [(1, "S2:1.1")]
    assert len(R.exact_lookup(a, s, c, all_standards=True).collect()) == 3


def test_fragments_and_prompts(spark):
    cands = spark.createDataFrame([(1, "a", 1), (1, "gone", 2), (1, "b", 3), (2, "gone", 1)], "question_id int, clause_id string, rank int")
    clauses = spark.createDataFrame([("a", "S", "1.1", "p", 'say "x"'), ("b", "T", "1.2", "p", "y 3.5 mm")], "clause_id string, standard_id string, clause_no string, path string, text string")
    standards = spark.createDataFrame([("S", "GB 1-2000", "n", "现行")], "standard_id string, standard_no string, standard_name string, status string")
    rows = C.fragments(cands, clauses, standards)
    assert [(r.source_id, r.clause_id, r.standard_no) for r in rows.orderBy("ord").collect()] == [("S1", "a", "GB 1-2000"), ("S2", "b", "")]
    js = C.context_json(rows).first().context
    assert js.startswith('[{"clause_no":"1.1","formulas":[],"is_mandatory":false,') and '"text":"say \\"x\\""' in js
    qs = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q3")], "question_id int, question string")
    out = {r.question_id: r for r in C.prompts(qs, cands, C.context_json(rows)).collect()}
    assert "q1" in out[1].user_prompt and "S1" in out[1].user_prompt and out[1].refusal is None
    assert out[2].refusal == C.NO_SOURCE and out[3].refusal == C.NO_CANDIDATES and out[3].user_prompt is None
    final = {r.question_id: r for r in C.answer(qs, cands, clauses, standards).collect()}
    assert final[1].all_verified and "GB 1-2000" in final[1].final and final[3].final == C.NO_CANDIDATES
    big = C.small_to_big(rows, spark.createDataFrame([("c1", "a", "whole"), ("c2", "b", "y 3.5 mm")], "chunk_id string, node_id string, context_text string"))
    assert {r.clause_id: r.text for r in big.collect()} == {"a": 'say "x"\n【父级上下文】whole', "b": "y 3.5 mm"}


def check(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "s", "bad"), [("压实度 96%，厚 150 mm", "不小于96 %，150mm", []), ("98%", "96%", ["98%"]), ("5", "5 mm", []), ("5 cm", "5 mm", ["5 cm"]), ("无", "", [])])
def test_numbers(spark, a, s, bad):
    assert [x.raw for x in check(spark, T.unverified_numbers(F.col("a"), F.col("s")), a=a, s=s)] == bad
    assert check(spark, T.unverified_numbers(F.col("a"), F.col("a")), a=a, s=s) == []


@pytest.mark.parametrize(("a", "loose", "strict"), [("第4.2.1条", True, True), ("14.2.1", True, False), ("4.2.10", False, False), ("4.2.1.1", True, False), ("4x2x1", False, False)])
def test_citation(spark, a, loose, strict):
    assert check(spark, T.cites_clause(F.col("a"), F.col("g")), a=a, g="4.2.1") == loose
    assert check(spark, T.cites_clause(F.col("a"), F.col("g"), strict=True), a=a, g="4.2.1") == strict


def test_metrics(spark):
    d = spark.createDataFrame([(["b", "a"], "a"), (["b"], "a"), (None, "a")], "ranked array<string>, gold string")
    rows = E.retrieval_metrics(d).collect()
    assert [(r.recall_3, r.hit_1, r.rr) for r in rows] == [(1, 0, 0.5), (0, 0, 0.0), (0, 0, 0.0)]


def test_eval_run(spark):
    cases = spark.createDataFrame([(1, "GB 1-2000", "1.1", True, True), (2, "", "", False, False), (3, "GB 9-2000", "1.1", True, True)], "case_id int, gold_standard_no string, gold_clause_no string, should_answer boolean, must_cite boolean")
    cands = spark.createDataFrame([(1, 1, "S:1.1")], "case_id int, rank int, clause_id string")
    answers = spark.createDataFrame([(1, "第1.1条"), (2, "拒答"), (3, "第2.2条")], "case_id int, answer string")
    r = E.run(cases, cands, answers, spark.createDataFrame([("GB 1-2000", "S")], "standard_no string, standard_id string")).first()
    assert (r.total, r.recall_at_3, r.mrr, r.citation_accuracy, r.refusal_accuracy, r.generation_evaluated) == (3, 1.0, 1.0, 0.5, 1.0, 2)


@pytest.mark.parametrize(("rows", "out"), [([(0.9, True), (0.8, True), (0.7, True), (0.2, False), (0.1, False), (0.15, False)], (0.7, 0.0, 0.0)), ([], (0.0, 0.0, 0.0)), ([(0.5, True), (0.6, True)], (0.5, 0.0, 0.0)), ([(0.4, False), (0.6, False)], (0.6, 0.0, 0.5))])
def test_calibration(spark, rows, out):
    assert tuple(E.calibrate(spark.createDataFrame(rows, "top_score double, should_answer boolean")).first()) == out


def test_router_and_degrade(spark):
    q = spark.createDataFrame([(1, "GB 50010-2010 限值"), (2, "表里的值"), (3, "第3页有什么"), (4, "流程图在哪"), (5, "plain")], "question_id int, question string")
    assert {r.question_id: r.mode for r in R.route_mode(R.analyse(q)).collect()} == {1: "text", 2: "text", 3: "visual", 4: "both", 5: "text"}
    fused, notices = R.degrade({"dense": None, "bm25": lists(spark)[1][1]}, 5)
    assert notices == ["dense unavailable"] and fused.count() == 2
    with pytest.raises(ValueError, match="no recall path"):
        R.degrade({"dense": None}, 5)


def test_budget_keeps_own_text(spark):
    p = spark.createDataFrame([(1, 1, 1, "x" * 50), (1, 2, 2, "y" * 10), (1, 3, 3, "z" * 5)], "question_id int, priority int, ord int, text string")
    assert {r.ord for r in C.budget(p, 20).collect()} == {1} and {r.ord for r in C.budget(p, 60).collect()} == {1, 2}


def test_versions_and_references(spark):
    v = spark.createDataFrame([("f", "a", 1), ("f", "b", 5), ("f", "c", 9)], "family string, standard_id string, effective int")
    assert {r.standard_id: (r.status, r.replaces, r.replaced_by) for r in V.version_chain(v, F.lit(6)).collect()} == {"a": ("作废", None, "b"), "b": ("现行", "a", "c"), "c": ("即将实施", "b", None)}
    hits = spark.createDataFrame([(1, "a"), (1, "b")], "question_id int, clause_id string")
    refs = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "c"), ("b", "d"), ("b", "x")], "clause_id string, target_id string")
    aux, warn = V.expand_references(hits, refs, spark.createDataFrame([("a", "现行"), ("b", "现行"), ("c", "现行"), ("d", "作废")], "clause_id string, status string"))
    assert [r.clause_id for r in aux.collect()] == ["c"] and [r.clause_id for r in warn.collect()] == ["d"]
    up = V.partial_upsert(spark.createDataFrame([("n", "old", 1, 1), ("n", "new", 2, 2)], "node_id string, text string, page int, seq int"), ["node_id"], ["text"], ["page"]).first()
    assert (up.text, up.page) == ("new", 1)
    rec = V.reconcile(spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, s string"), spark.createDataFrame([(2, None), (3, "x"), (4, "d")], "k int, s string"), "k", ["s"])
    assert {r.k: r.action for r in rec.collect()} == {1: "insert", 2: "ok", 3: "update", 4: "delete"}

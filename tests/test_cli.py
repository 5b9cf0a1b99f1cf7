from clausemill import schema
from clausemill.__main__ import main, run_eval, run_query


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "JTG.txt").write_text("公路路基 JTG D60-2015\n4.2 压实\n4.2.1 压实度不应小于 96%。\f4.2.2 厚度为 150 mm。")
    src, store = str(tmp_path / "JTG.txt"), str(tmp_path / "store")
    assert main(["smoke"]) == 0 and main([]) == 1 and main(["query"]) == 1
    assert main(["ingest", src, store]) == 0
    assert "4.2.1" in run_query(spark, store, "JTG D60-2015 第4.2.1条") and "150 mm" in run_query(spark, store, "厚度是多少")
    assert "无法作答" in run_query(spark, store, "qqq zzz")
    (tmp_path / "d.json").write_text('[{"question": "压实度不应小于多少", "gold_standard_no": "JTG D60-2015", "gold_clause_no": "4.2.1", "must_cite": true}, {"question": "qqq", "should_answer": false}]')
    row = run_eval(spark, store, str(tmp_path / "d.json")).first()
    assert (row.total, row.recall_at_3, row.citation_accuracy, row.refusal_accuracy) == (2, 1.0, 1.0, 1.0)
    assert main(["dump", src, str(tmp_path / "out")]) == 0


def test_schema(spark):
    row = schema.conform(spark.createDataFrame([("S", None)], "standard_id string, status string"), "standards").first()
    assert (row.standard_id, row.status, row.access_level, row.standard_no) == ("S", "现行", "public", None)
    assert all(spark.createDataFrame([], ddl).columns for ddl in schema.TABLES.values())

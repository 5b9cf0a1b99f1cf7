import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clausemill.operators import nearest
from clausemill.operators import retrieval as R

V = "clause_id string, standard_id string, dense array<double>"
Q = "question_id int, query array<double>"
QUERIES = ["cross_modal_fuse", "eval_summary", "ab_compare", "dense_topk", "dense_batch_topk", "rerank_fallback", "visual_page_recall", "retrieval_metrics", "eval_run", "dense_filtered_topk"]


class Shared:
    def __init__(self, value):
        self.value = value


def brute(questions, vectors, k):
    out = set()
    for q, a in questions:
        scored = sorted((-round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 9), i) for i, _, b in vectors if len(a) == len(b))
        out |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("name", QUERIES)
def test_no_join_scores_pairs(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan.lower()


def test_many_questions_read_the_vectors_once(spark):
    r = np.random.default_rng(1)
    vectors = [(f"v{n % 700}-{n}", "S", x) for n, x in enumerate(r.integers(-3, 4, (900, 4)).astype(float).tolist()) if any(x)]  # many equal cosines
    questions = [(n, x) for n, x in enumerate(r.integers(-3, 4, (1300, 4)).astype(float).tolist()) if any(x)] + [(5000, [1.0]), (5001, None)]
    out = R.dense_top_k(spark.createDataFrame(questions, Q), spark.createDataFrame([*vectors, ("short", "S", [1.0, 2.0]), ("none", "S", None)], V), 7)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(x.question_id, x.clause_id, x.score, x["rank"]) for x in out.collect()} == brute([q for q in questions if q[1] and len(q[1]) == 4], vectors, 7)


def test_blocks_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(nearest, "MATRIX", 8)  # blocks of about four questions
    v = spark.createDataFrame([("zero", "S", [0.0, 0.0]), ("null", "S", [None, 1.0]), ("b", "S", [1.0, 0.0]), ("a", "S", [2.0, 0.0]), ("nan", "S", [math.nan, 1.0])], V)
    q = spark.createDataFrame([(n, [1.0, 0.0]) for n in range(9)] + [(None, [1.0, 0.0]), (20, [0.0, 0.0])], Q)
    rows = R.dense_top_k(q, v, 6).collect()
    for n in [*range(9), None]:
        found = [(r.clause_id, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.question_id == n]
        assert [i for i, _ in found] == ["nan", "zero", "a", "b", "null"]
        assert found[-1][1] is None and math.isnan(found[0][1])
    assert [r.clause_id for r in sorted(rows, key=lambda r: r["rank"]) if r.question_id == 20] == ["a", "b", "nan", "zero", "null"]
    assert R.dense_top_k(q.filter("false"), v, 2).count() == 0 == R.dense_top_k(q, v.filter("false"), 2).count()


def test_equal_vectors_leave_a_worker_k_times(monkeypatch):
    monkeypatch.setattr(nearest, "HELD", 1000)
    n, asked, k = 3000, 40, 5
    lists = lambda rows: pa.array(rows, pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i:05}" for i in range(n)][::-1]), pa.array(["S"] * n), lists([[1.0, 2.0]] * n)], names=["clause_id", "standard_id", "dense"])
    out = pa.Table.from_batches(nearest.finder(Shared(lists([[2.0, 1.0]] * asked)), k)(iter([batch, batch.slice(0, 100)])))
    best = out.group_by("qn").aggregate([("clause_id", "min"), ("clause_id", "count")]).to_pylist()
    assert len(best) == asked and all(b["clause_id_min"] == "00000" for b in best)
    assert out.num_rows <= n * asked / 20


def test_many_questions_with_a_filter(spark):
    vectors = spark.range(300).select(F.concat(F.lit("D"), "id").alias("clause_id"), F.lit("S").alias("standard_id"), F.array(F.sin("id"), F.cos("id")).alias("dense"), "id")
    asked = spark.range(1100).select(F.col("id").alias("question_id"), F.array(F.sin("id"), F.cos("id")).alias("query"))
    rows = R.dense_top_k(asked, vectors, 1, where=F.col("id") % 2 == 0).collect()
    assert len(rows) == 1100 and all(int(r.clause_id[1:]) % 2 == 0 for r in rows)
    assert all(r.clause_id == f"D{r.question_id}" for r in rows if r.question_id < 300 and r.question_id % 2 == 0)

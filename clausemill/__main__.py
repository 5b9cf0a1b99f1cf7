"""python -m clausemill smoke | ingest PATH STORE | query STORE QUESTION | dump PATH OUT | eval STORE DATASET

PATH holds text files with form feeds between pages. Without an embedding service, recall is BM25 and exact lookup, and answers
are quotations.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import text as T
from .operators import context, evaluation, retrieval
from .plans.ingest import ingest
from .session import local_session
from .sources import readers

TOP_K, EVAL_DEPTH, EVAL_K = 5, 20, 10


def smoke(spark: SparkSession) -> int:
    """Number of probes that fail."""
    failures = 0
    for probe in (lambda: spark.range(10).count() == 10, lambda: spark.createDataFrame([("4.2.1 a",)], "t string").select(T.clause_head_no(F.col("t"))).first()[0] == "4.2.1"):
        try:
            failures += not probe()
        except Exception as error:
            print("FAIL", error)
            failures += 1
    print(f"{failures} failed")
    return failures


def run_ingest(spark: SparkSession, path: str, store: str) -> DataFrame:
    """Writes the tables under `store`; (standard_no, clause_count, passed)."""
    out = ingest(readers.text_pages(spark, path).select("doc_path", "page_no", "text"))
    for name, df in (("standards", out["standards"]), ("clause_nodes", out["tree"]), ("retrieval_chunks", out["chunks"]), ("page_clause_map", out["page_map"])):
        schema.conform(df, name).write.mode("overwrite").parquet(f"{store}/{name}")
    return out["reports"].select("standard_no", "clause_count", "passed")


def recall(spark: SparkSession, store: str, questions: DataFrame, depth: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(candidates, clauses, standards, chunks) for questions (question_id, question)."""
    standards = spark.read.parquet(f"{store}/standards")
    clauses = spark.read.parquet(f"{store}/clause_nodes").withColumnRenamed("node_id", "clause_id")
    chunks = spark.read.parquet(f"{store}/retrieval_chunks")
    admitted = standards.filter(retrieval.scalar_filter()).select("standard_id")
    pool = chunks.select(F.col("node_id").alias("clause_id"), "standard_id", F.col("retrieval_text").alias("text")).join(admitted, "standard_id", "left_semi")
    exact = retrieval.top_k(retrieval.exact_lookup(retrieval.analyse(questions), standards, clauses), depth)
    fused, _ = retrieval.degrade({"dense": None, "bm25": retrieval.bm25_top_k(questions, pool, depth), "exact": exact}, k)
    return retrieval.guard_access(fused, standards), clauses, standards, chunks


def run_query(spark: SparkSession, store: str, question: str) -> str:
    asked = spark.createDataFrame([(1, question)], "question_id long, question string")
    found, clauses, standards, chunks = recall(spark, store, asked, 4 * TOP_K, TOP_K)
    return context.answer(asked, found, clauses, standards, chunks).first()["final"]


def run_eval(spark: SparkSession, store: str, dataset: str) -> DataFrame:
    cases = readers.eval_cases(spark, dataset).withColumn("case_id", F.xxhash64("question", "gold_standard_no", "gold_clause_no"))
    asked = cases.select(F.col("case_id").alias("question_id"), "question")
    found, clauses, standards, chunks = recall(spark, store, asked, EVAL_DEPTH, EVAL_K)
    answers = context.answer(asked, found, clauses, standards, chunks).select(F.col("question_id").alias("case_id"), F.col("final").alias("answer"))
    return evaluation.run(cases, found.withColumnRenamed("question_id", "case_id"), answers, retrieval.current_first(standards))


def main(args: list[str]) -> int:
    arity = {"smoke": 1, "ingest": 3, "query": 3, "dump": 3, "eval": 3}
    if not args or arity.get(args[0]) != len(args):
        print(__doc__)
        return 1
    spark = SparkSession.getActiveSession() or local_session()
    if args[0] == "smoke":
        return int(smoke(spark) > 0)
    if args[0] == "ingest":
        run_ingest(spark, *args[1:]).show(truncate=False)
    elif args[0] == "query":
        print(run_query(spark, args[1], args[2]))
    elif args[0] == "dump":
        pages = readers.text_pages(spark, args[1])
        readers.dump_lines(pages).select("value").write.mode("overwrite").text(args[2])
        readers.dump_stats(pages).show(truncate=False)
    else:
        run_eval(spark, *args[1:]).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

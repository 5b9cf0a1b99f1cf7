"""Evaluation of retrieval and answers, threshold calibration, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def gold_ids(cases: DataFrame, standard_ids: DataFrame) -> DataFrame:
    """cases (case_id, gold_standard_no, gold_clause_no, ...) with gold: the node id, null if the standard isn't known."""
    return cases.join(standard_ids.select(F.col("standard_no").alias("gold_standard_no"), "standard_id"), "gold_standard_no", "left").withColumn("gold", F.when(F.coalesce("gold_clause_no", F.lit("")) != "", F.concat_ws(":", "standard_id", "gold_clause_no"))).withColumn("gold", F.when(F.col("standard_id").isNotNull(), F.col("gold"))).drop("standard_id")


def ranked_lists(candidates: DataFrame, by: str = "question_id") -> DataFrame:
    """(by, ranked): clause ids in order of rank."""
    return candidates.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "clause_id"))), lambda x: x["clause_id"]).alias("ranked"))


def retrieval_metrics(cases: DataFrame) -> DataFrame:
    """cases (ranked, gold, ...) with recall_3, hit_1 and rr."""
    ranked = F.coalesce("ranked", F.array().cast("array<string>"))
    return cases.withColumn("recall_3", T.recall_at(ranked, F.col("gold"), 3)).withColumn("hit_1", T.recall_at(ranked, F.col("gold"), 1)).withColumn("rr", F.coalesce(T.reciprocal_rank(ranked, F.col("gold")), F.lit(0.0)))


def summary(scored: DataFrame) -> DataFrame:
    """One row of means. Retrieval counts cases with a gold id, citation cases that should be answered and cited, refusal all; 0 where there are none."""
    cited = F.col("should_answer") & F.col("must_cite")
    mean = lambda v, where, name: F.round(F.coalesce(F.avg(F.when(where, v)), F.lit(0.0)), 9).alias(name)
    known = F.col("gold").isNotNull()
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        mean(F.col("recall_3").cast("double"), known, "recall_at_3"),
        mean(F.col("rr"), known, "mrr"),
        mean(F.col("hit_1").cast("double"), known, "hit_at_1"),
        mean(F.col("cited").cast("double"), cited, "citation_accuracy"),
        mean(F.col("refusal_ok").cast("double"), F.lit(True), "refusal_accuracy"),
        F.coalesce(F.sum(cited.cast("long")), F.lit(0)).alias("generation_evaluated"),
    )


def version_rates(cited: DataFrame) -> DataFrame:
    """One row of rates over citations (cited_id, gold_id, cited_status, cited_page, gold_page, node_id): right version, retired standards, right page, mapped to a node. No rows: zeros."""
    rate = lambda c, name: F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0)), 9).alias(name)
    return cited.agg(
        F.count(F.lit(1)).alias("total"),
        rate(F.col("cited_id") == F.col("gold_id"), "version_accuracy"),
        rate(F.col("cited_status") != T.CURRENT, "retired_misuse"),
        rate(F.col("cited_page") == F.col("gold_page"), "page_hit"),
        rate(F.col("node_id").isNotNull(), "mapping_success"),
    )


def run(cases: DataFrame, candidates: DataFrame, answers: DataFrame, standard_ids: DataFrame) -> DataFrame:
    """Summary of cases (case_id, gold_standard_no, gold_clause_no, should_answer, must_cite), candidates and answers (case_id, answer)."""
    met = gold_ids(cases, standard_ids).join(ranked_lists(candidates, "case_id"), "case_id", "left").join(answers, "case_id", "left")
    text = F.coalesce("answer", F.lit(""))
    judged = retrieval_metrics(met).withColumn("cited", T.cites_clause(text, F.coalesce("gold_clause_no", F.lit("")))).withColumn("refusal_ok", T.refusal_correct(F.col("should_answer"), T.is_refusal(text)))
    return summary(judged)


def calibrate(samples: DataFrame) -> DataFrame:
    """threshold, false_refusal_rate, wrong_answer_rate of samples (top_score, should_answer): the distinct score as cut with the least sum of both rates, the higher at a tie.

    Every cut's counts come from running sums over the distinct scores, which are dealt by range, so no task sees all of them. No rows: zeros.
    """
    cuts = samples.groupBy(F.col("top_score").alias("cut")).agg(F.sum(F.col("should_answer").cast("long")).alias("yes"), F.sum((~F.col("should_answer")).cast("long")).alias("no"))
    # hashable ranges of the score: sums per range first, running sums inside
    ranged = cuts.withColumn("part", F.floor(F.col("cut") * 1024))
    parts = ranged.groupBy("part").agg(F.sum("yes").alias("py"), F.sum("no").alias("pn"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("py").over(before), F.lit(0)).alias("y0"), F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("n0"))
    totals = parts.agg(F.sum("py").alias("yes_all"), F.sum("pn").alias("no_all"))
    inside = Window.partitionBy("part").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumn("y", F.coalesce(F.sum("yes").over(inside), F.lit(0))).withColumn("n", F.coalesce(F.sum("no").over(inside), F.lit(0))).join(offsets, "part").join(F.broadcast(totals))  # one row of totals
    rate = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    false = rate(F.col("y0") + F.col("y"), F.col("yes_all"))
    wrong = rate(F.col("no_all") - F.col("n0") - F.col("n"), F.col("no_all"))
    rated = running.select("cut", false.alias("false_refusal_rate"), wrong.alias("wrong_answer_rate"))
    best = rated.orderBy(F.round(F.col("false_refusal_rate") + F.col("wrong_answer_rate"), 12), F.col("cut").desc()).limit(1)
    zero = samples.sparkSession.range(1).select(F.lit(0.0).alias("z"))
    return zero.join(best, F.lit(True), "left").select(F.coalesce("cut", "z").alias("threshold"), F.coalesce("false_refusal_rate", "z").alias("false_refusal_rate"), F.coalesce("wrong_answer_rate", "z").alias("wrong_answer_rate"))


def compare(scored: DataFrame, metrics: list[str], base: str, other: str) -> DataFrame:
    """(metric, base_mean, other_mean, delta) of two variants."""
    means = [F.avg(F.when(F.col("variant") == v, F.col(m).cast("double"))).alias(f"{m}_{n}") for m in metrics for n, v in enumerate((base, other))]
    row = scored.agg(*means)
    listed = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(f"{m}_0"), 9).alias("base_mean"), F.round(F.col(f"{m}_1"), 9).alias("other_mean"), F.round(F.col(f"{m}_1") - F.col(f"{m}_0"), 9).alias("delta")) for m in metrics])
    return row.select(F.explode(listed).alias("r")).select("r.*")

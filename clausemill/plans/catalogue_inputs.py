"""Inputs of the catalogue's queries, derived from the test tables in the same way as in their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import table


def vectors_of(e: DataFrame) -> DataFrame:
    return e.select(F.concat(F.lit("D"), "vec_id").alias("clause_id"), F.concat(F.lit("S"), F.col("vec_id") % 50).alias("standard_id"), F.col("embedding").alias("dense"), "label")


def corpus(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, clauses, standards): documents as clauses of 50 standards, every fifth retired, every seventh internal."""
    clauses = table(spark, sf, "documents").select(F.concat(F.lit("D"), "doc_id").alias("clause_id"), F.concat(F.lit("S"), F.col("doc_id") % 50).alias("standard_id"), F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit(".1.1")).alias("clause_no"), F.lit("p").alias("path"), "text")
    n = F.col("id")
    standards = spark.range(50).select(F.concat(F.lit("S"), n).alias("standard_id"), F.concat(F.lit("GB "), 50000 + n, F.lit("-2015")).alias("standard_no"), F.concat(F.lit("name "), n).alias("standard_name"), F.when(n % 5 == 0, T.RETIRED).otherwise(T.CURRENT).alias("status"), F.when(n % 7 == 0, "internal").when(n % 11 != 0, "public").alias("access_level"))
    return vectors_of(table(spark, sf, "embeddings")), clauses, standards


def document_questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("question_id"), F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("GB "), 50000 + F.col("item_id") + 1, F.lit("-2015 2.1.1 "), "text")).when(F.col("item_id") % 4 == 1, F.concat(F.lit("GB 59999-2015 "), "text")).otherwise(F.col("text")).alias("question"))


def questions_with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query"))
    return document_questions(spark, sf).join(e, "question_id")


def order_standards(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.concat(F.lit("S"), "o_orderkey").alias("standard_id"), F.concat(F.lit("GB "), 50000 + F.col("o_orderkey") % 2000, F.lit("-2010")).alias("standard_no"), F.when(F.col("o_orderstatus") == "F", T.RETIRED).otherwise(T.CURRENT).alias("status"))


def line_clauses(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select(F.concat(F.lit("S"), "l_orderkey").alias("standard_id"), F.concat("l_linenumber", F.lit("."), F.col("l_suppkey") % 2 + 1, F.lit(".1")).alias("clause_no"))
    return l.distinct().withColumn("clause_id", F.concat_ws(":", "standard_id", "clause_no"))


def clause_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages; every third line gets a clause number, in full-width characters in even documents."""
    number = lambda i: F.concat((F.col("doc_id") % 7 + 1).cast("string"), F.lit("."), F.floor(i / 3 + 1).cast("string"), F.lit(".2"))
    shown = lambda i: F.when(F.col("doc_id") % 2 == 0, F.translate(number(i), T.HALF_WIDTH[1:], T.FULL_WIDTH[1:])).otherwise(number(i))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(shown(i), F.lit(" "), x)).otherwise(F.concat(F.lit("  "), x)))
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_path"), F.lit(1).alias("page_no"), F.array_join(lines, "\n").alias("text"))


def headings(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of three levels from order lines; some parents are missing."""
    chapter, section = (F.col("l_orderkey") % 50 + 1).cast("string"), (F.col("l_suppkey") % 5 + 1).cast("string")
    number = F.when((F.col("l_linenumber") == 4) & (F.col("l_orderkey") % 50 < 40), chapter).when(F.col("l_linenumber") == 5, F.concat(chapter, F.lit("."), section)).when(F.col("l_linenumber") == 6, F.lit("")).otherwise(F.concat(chapter, F.lit("."), section, F.lit("."), F.col("l_linenumber")))
    return table(spark, sf, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey") % 3).alias("standard_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("ord"), number.alias("clause_no"), F.concat(F.lit("h"), "l_partkey").alias("title"), F.concat(F.lit("t"), "l_partkey").alias("text"), (F.col("l_linenumber") - 1).alias("page_no"))


def cells_input(spark: SparkSession, sf: str) -> DataFrame:
    """A table of two columns for each part, with attributes, inner tags, spaces and line breaks."""
    price = F.format_string("%.2f", F.col("p_retailprice"))
    html = F.concat(
        F.lit("<table>\n<TR><th>name</th><th>value (mm)</th><th>说明（m）</th></TR><tr class='x'>\n<td>size</td><td> <b>"), F.col("p_size").cast("string"), F.lit("</b> </td><td>-</td></tr><tr><td>retail</td><td>约 "), price, F.lit("</td><td>"), F.col("p_brand"), F.lit("</td></tr></table>")
    )
    return table(spark, sf, "part").select(F.lit("S").alias("standard_id"), F.col("p_size").alias("page_no"), F.col("p_partkey").alias("table_index"), html.alias("html"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, answer, source, gold, should_answer) of every turn with derived numbers, citations and refusals."""
    n = F.col("conv_id")
    answer = F.when(n % 11 == 0, F.lit("未检索到相关依据")).otherwise(F.concat(F.lit("依据第 "), F.when(n % 3 == 0, "4.2.1").when(n % 3 == 1, "14.2.1").otherwise("4.2.10"), F.lit(" 条，压实度 "), 90 + n % 10, F.when(n % 2 == 0, "%").otherwise(" mm"), F.lit("，厚 "), n % 7, F.lit(".5")))
    source = F.concat(F.lit("4.2.1 14.2.1 压实度不应小于 "), 90 + n % 8, F.when(n % 4 < 3, "%").otherwise(""), F.lit(" 厚 "), n % 5, F.lit(".50 m，"), F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", answer.alias("answer"), source.alias("source"), F.lit("4.2.1").alias("gold"), (n % 5 != 0).alias("should_answer"))

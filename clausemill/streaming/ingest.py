"""Clauses of arriving pages, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.structure import split_clauses

PAGES = "doc_path string, page_no int, text string"


def clause_rows(pages: DataFrame) -> DataFrame:
    """(node_id, standard_id, clause_no, text, page_start, ord) of pages."""
    sid = T.make_id(F.col("doc_path"))
    return split_clauses(pages).select(F.concat_ws(":", sid, "clause_no").alias("node_id"), sid.alias("standard_id"), "clause_no", "text", "page_start", "ord")


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Reads pages as they arrive as Parquet and writes each batch's clauses under its own folder, so a batch that runs twice replaces itself.

    read_clauses() gives the present state.
    """

    def write(batch: DataFrame, number: int) -> None:
        clause_rows(batch).withColumn("seq", F.lit(number).cast("long") * 1_000_000_000 + F.col("page_start") * 10_000 + F.col("ord")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(PAGES).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_clauses(spark: SparkSession, target: str) -> DataFrame:
    """One row for each node: the last text, the first page."""
    rows = spark.read.parquet(target)
    return rows.groupBy("node_id").agg(F.max_by("text", "seq").alias("text"), F.max_by("clause_no", "seq").alias("clause_no"), F.min_by("page_start", "seq").alias("page_start"), F.min_by("standard_id", "seq").alias("standard_id"))

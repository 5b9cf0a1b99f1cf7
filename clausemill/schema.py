"""Table schemas of the store, and their idempotent creation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the stored tables.
TABLES = {
    "doc_pages": "doc_path STRING, page_no INT, text STRING",
    "standards": "standard_id STRING, standard_no STRING, standard_name STRING, status STRING, file_path STRING, access_level STRING, review_status STRING",
    "clause_nodes": "node_id STRING, standard_id STRING, parent_id STRING, node_type STRING, clause_no STRING, title STRING, path STRING, level INT, page_start INT, text STRING, is_mandatory BOOLEAN, refs ARRAY<STRING>, status STRING",
    "retrieval_chunks": "chunk_id STRING, node_id STRING, standard_id STRING, atomic_text STRING, retrieval_text STRING, context_text STRING, chunk_type STRING",
    "page_clause_map": "standard_id STRING, page_no INT, node_id STRING, coverage_type STRING",
    "spec_tables": "table_id STRING, standard_id STRING, node_id STRING, caption STRING, page_no INT, table_html STRING, table_markdown STRING, table_summary STRING",
    "spec_table_cells": "cell_id STRING, table_id STRING, row_idx INT, col_idx INT, row_header STRING, col_header STRING, cell_text STRING, number_value DOUBLE, unit STRING, merged_info STRING",
    "clause_vectors": "node_id STRING, standard_id STRING, dense ARRAY<FLOAT>",
    "candidates": "question_id BIGINT, standard_id STRING, clause_id STRING, score DOUBLE, source STRING",
    "clause_metadata": "node_id STRING, summary STRING, applicable_condition STRING, keywords ARRAY<STRING>, common_questions ARRAY<STRING>, enrich_model_version STRING, enriched_at TIMESTAMP",
    "page_visual": "page_id STRING, standard_id STRING, standard_no STRING, page_no INT, status STRING, access_level STRING, image_path STRING, visual ARRAY<FLOAT>",
    "page_blocks": "block_id STRING, standard_id STRING, page_no INT, block_type STRING, bbox STRING, ocr_text STRING, related_node_id STRING, image_path STRING, quality_score DOUBLE",
    "routing_log": "query STRING, features STRING, route STRING, hits INT, adopted BOOLEAN",
}
DEFAULTS = {"status": "现行", "access_level": "public", "review_status": "passed"}


def create_tables(spark: SparkSession, database: str) -> list[str]:
    """Creates what is missing; existing tables stay as they are."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return sorted(TABLES)


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in their types and order; missing ones are null or their default."""
    columns = [c.strip().split(" ", 1) for c in _split(TABLES[name])]
    return df.select(*[(F.coalesce(F.col(c), F.lit(DEFAULTS[c])) if c in DEFAULTS and c in df.columns else F.col(c) if c in df.columns else F.lit(DEFAULTS.get(c))).cast(kind).alias(c) for c, kind in columns])


def _split(ddl: str) -> list[str]:
    return ddl.split(", ")

"""Ingest: pages to standards, clauses, hierarchy, chunks, page map and gate, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import structure as S
from ..sources import readers


def standards_of(pages: DataFrame) -> DataFrame:
    """(doc_path, standard_id, standard_no, standard_name, status, file_path) from each file's first page."""
    first = pages.groupBy("doc_path").agg(F.min_by("text", "page_no").alias("text"))
    name = T.stem(F.col("doc_path"))
    return first.select("doc_path", T.make_id(F.col("doc_path")).alias("standard_id"), T.extract_standard_no(F.col("text"), name).alias("standard_no"), name.alias("standard_name"), F.lit(T.CURRENT).alias("status"), F.col("doc_path").alias("file_path"))


def ingest(pages: DataFrame) -> dict[str, DataFrame]:
    """standards, clauses (one a node, the last text and the first page), tree, chunks, page_map, reports of (doc_path, page_no, text).

    Chunks are those of documents that pass the gate. Plain text has no OCR confidence and counts as 1.
    """
    standards = standards_of(pages)
    clauses = S.split_clauses(pages).join(standards.select("doc_path", "standard_id"), "doc_path").withColumn("seq", F.struct("page_start", "ord"))
    nodes = clauses.groupBy("standard_id", "clause_no").agg(F.max_by("text", "seq").alias("text"), F.min_by("page_start", "seq").alias("page_start")).withColumn("node_id", F.concat_ws(":", "standard_id", "clause_no"))
    elements = S.line_elements(pages).join(standards.select("doc_path", "standard_id"), "doc_path")
    tree = S.clause_tree(elements.select("standard_id", "ord", "clause_no", "title", "text", "page_no"))
    counts = tree.filter("node_type in ('clause', 'item', 'section')").groupBy("standard_id").agg(F.count(F.lit(1)).alias("clause_count"))
    reports = S.quality_gate(standards.join(counts, "standard_id", "left").withColumn("avg_ocr_confidence", F.lit(1.0)))
    passed = reports.filter("passed").select("standard_id")
    chunks = S.build_chunks(tree, standards.select("standard_id", "standard_no", "standard_name")).join(passed, "standard_id", "left_semi")
    return {"standards": standards, "clauses": nodes, "tree": tree, "chunks": chunks, "page_map": S.page_map(tree), "reports": reports}


def ingest_layout(documents: DataFrame, column: str = "json") -> dict[str, DataFrame]:
    """standards, tree, chunks, page_map, tables, cells, reports of layout-parser JSON.

    A text goes to the heading before it. The standard number is the parser's, else the first in the title, else the file's stem, normalised. Chunks are
    those of documents that pass the gate, whose confidence is the elements' mean.
    """
    found = readers.layout_elements(documents, column).withColumn("standard_id", T.make_id(F.col("source_path")))
    name = T.stem(F.col("source_path"))
    number = T.normalize_standard_no(F.when(F.max("standard_no") != "", F.max("standard_no")).otherwise(T.extract_standard_no(F.max("title"), F.max(name))))
    standards = found.groupBy("standard_id", "source_path").agg(number.alias("standard_no"), F.max(name).alias("standard_name"), F.avg("ocr_confidence").alias("avg_ocr_confidence")).withColumn("status", F.lit(T.CURRENT))
    order = Window.partitionBy("standard_id").orderBy("ord")
    lines = found.filter("type in ('Heading', 'Text')").withColumn("head", F.sum((F.col("clause_no") != "").cast("int")).over(order)).filter("head > 0")
    headed = lines.groupBy("standard_id", "head").agg(F.min("ord").alias("ord"), F.max("clause_no").alias("clause_no"), F.min_by("element_title", "ord").alias("title"), S._ordered_concat("ord", "text").alias("text"), F.min_by("page_no", "ord").alias("page_no"))
    tree = S.clause_tree(headed)
    tables = S.structure_tables(S.table_owner(found.filter("type = 'Table'").select("standard_id", "page_no", F.col("ord").alias("table_index"), F.col("table_html").alias("html"), "caption"), tree))
    counts = tree.filter("node_type in ('clause', 'item', 'section')").groupBy("standard_id").agg(F.count(F.lit(1)).alias("clause_count"))
    reports = S.quality_gate(standards.join(counts, "standard_id", "left"))
    chunks = S.build_chunks(tree, standards.select("standard_id", "standard_no", "standard_name")).join(reports.filter("passed").select("standard_id"), "standard_id", "left_semi")
    return {"standards": standards, "tree": tree, "chunks": chunks, "page_map": S.page_map(tree), "tables": tables, "cells": S.table_cells(tables), "reports": reports}


def ingest_routed(pages: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """standards, tree, chunks, page_map, reports of files, each from its page texts or from its layout-parser JSON (source_path, json), as parser_route() tells."""
    route = S.parser_route(pages, ["doc_path"], T.is_pdf(F.col("doc_path")) | F.col("doc_path").endswith(".txt")).select("doc_path", "route")
    plain = ingest(pages.join(route.filter("route = 'text'").select("doc_path"), "doc_path", "left_semi"))
    laid = ingest_layout(documents.join(route.filter("route = 'layout'").select(F.col("doc_path").alias("source_path")), "source_path", "left_semi"))
    both = lambda name, *columns: plain[name].select(*columns).unionByName(laid[name].select(*columns))
    return {
        "standards": both("standards", "standard_id", "standard_no", "standard_name", "status"),
        "tree": both("tree", *plain["tree"].columns), "chunks": both("chunks", *plain["chunks"].columns), "page_map": both("page_map", *plain["page_map"].columns),
        "reports": both("reports", "standard_id", "standard_no", "clause_count", "avg_ocr_confidence", "issues", "passed"),
        "tables": laid["tables"], "cells": laid["cells"],
    }

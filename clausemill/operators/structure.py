"""Clause structure of parsed pages: clauses, hierarchy, chunks, tables, page map, routing and gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

DEPTH = 4  # levels of a clause number


def _ordered_concat(order: str, piece: str, separator: str = "") -> Column:
    """The pieces of a group in order; sorted inside the aggregate, as a shuffle keeps none."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, piece))), lambda x: x[piece]), separator)


def lines_of(pages: DataFrame) -> DataFrame:
    """(doc_path, page_no, ln, line): normalised lines of (doc_path, page_no, text); CRLF counts as a line break."""
    body = F.regexp_replace(T.normalize_fullwidth(F.coalesce("text", F.lit(""))), "\r\n", "\n")
    return pages.select("doc_path", "page_no", F.posexplode(F.split(body, "\n")).alias("ln", "line"))


def split_clauses(pages: DataFrame) -> DataFrame:
    """(doc_path, page_start, ord, clause_no, text): a head line begins a clause, further lines of the same page are
    joined to it without a separator, blank lines and what precedes a page's first head are dropped."""
    lines = lines_of(pages).withColumn("no", T.clause_head_no(F.col("line")))
    page = Window.partitionBy("doc_path", "page_no").orderBy("ln")
    marked = lines.withColumn("ord", F.sum((F.col("no") != "").cast("int")).over(page)).filter("ord > 0")
    piece = F.when(F.col("no") != "", T.clause_head_text(F.col("line"))).otherwise(F.regexp_replace("line", r"^[ \t\r]+", ""))
    return (
        marked.withColumn("piece", piece)
        .groupBy("doc_path", F.col("page_no").alias("page_start"), "ord")
        .agg(F.max("no").alias("clause_no"), _ordered_concat("ln", "piece").alias("text"))
    )


def line_elements(pages: DataFrame) -> DataFrame:
    """(doc_path, ord, type, level, clause_no, title, text, page_no): clause and chapter heads as headings; other lines go to the element before them, across pages."""
    lines = lines_of(pages).filter(~T.is_blank(F.col("line")))
    no = T.clause_head_no(F.col("line"))
    chapter = F.regexp_extract("line", T.CHAPTER_HEAD, 1)
    document = Window.partitionBy("doc_path").orderBy("page_no", "ln")
    marked = lines.select("*", F.when(no != "", no).otherwise(chapter).alias("no"), F.when(no != "", 3).when(chapter != "", 1).alias("lv"))
    grouped = marked.withColumn("ord", F.sum((F.col("no") != "").cast("int")).over(document)).withColumn("seq", F.row_number().over(document))
    rest = F.when(F.col("no") == "", F.trim("line"))
    head = F.when(F.col("lv") == 3, T.clause_head_text(F.col("line"))).when(F.col("lv") == 1, F.regexp_extract("line", T.CHAPTER_HEAD, 2))
    return (
        grouped.withColumn("piece", F.coalesce(rest, head, F.lit("")))
        .groupBy("doc_path", "ord")
        .agg(F.when(F.max("lv").isNotNull(), "Heading").otherwise("Text").alias("type"), F.coalesce(F.max("lv"), F.lit(0)).alias("level"), F.max("no").alias("clause_no"), F.coalesce(F.max(head), F.lit("")).alias("title"), _ordered_concat("seq", "piece").alias("text"), F.min("page_no").alias("page_no"))
    )


def clause_tree(headings: DataFrame) -> DataFrame:
    """Hierarchy of (standard_id, ord, clause_no, title, text, page_no) headings.

    node_id, standard_id, parent_id, node_type, clause_no, title, path, level, page_start, text, ord. Equal numbers of a standard are one node: texts in
    order, the rest from the first. A path leads over the ancestors up to the first that is missing.
    """
    named = headings.filter(F.coalesce("clause_no", F.lit("")) != "")
    nodes = named.groupBy("standard_id", "clause_no").agg(F.min("ord").alias("ord"), F.min_by("title", "ord").alias("title"), _ordered_concat("ord", "text").alias("text"), F.min_by("page_no", "ord").alias("page_start"))
    chained = nodes.withColumn("anc_0", F.col("clause_no"))
    # a number has at most DEPTH levels, so its ancestors are found by DEPTH - 1 joins to the parent's number
    for k in range(1, DEPTH):
        parent = nodes.select("standard_id", F.col("clause_no").alias(f"anc_{k}"), F.col("clause_no").alias("up"))
        chained = chained.withColumn("up", T.parent_clause_no(F.col(f"anc_{k - 1}"))).join(parent, ["standard_id", "up"], "left").drop("up")
    ancestors = F.array_compact(F.array(*[F.col(f"anc_{k}") for k in range(DEPTH - 1, -1, -1)]))
    return chained.select(
        F.concat_ws(":", "standard_id", "clause_no").alias("node_id"),
        "standard_id",
        F.when(F.col("anc_1").isNotNull(), F.concat_ws(":", "standard_id", "anc_1")).otherwise(F.lit("")).alias("parent_id"),
        T.node_type(F.col("clause_no")).alias("node_type"),
        "clause_no",
        "title",
        F.array_join(ancestors, " / ").alias("path"),
        F.size(ancestors).alias("level"),
        "page_start",
        "text",
        "ord",
    )


def build_chunks(tree: DataFrame, standards: DataFrame) -> DataFrame:
    """Own, retrieval and context text of each node but chapters. standards: (standard_id, standard_no, standard_name)."""
    parents = tree.select(F.col("node_id").alias("parent_id"), F.col("text").alias("parent_text"))
    blank = lambda c: F.coalesce(c, F.lit(""))  # noqa: E731  missing parts stay as empty ones
    return (
        tree.filter("node_type != 'chapter'")
        .join(parents, "parent_id", "left")
        .join(standards, "standard_id", "left")
        .select(
            F.concat("node_id", F.lit("#"), "node_type").alias("chunk_id"),
            "node_id",
            "standard_id",
            F.col("text").alias("atomic_text"),
            F.concat_ws(" ", blank("standard_no"), blank("standard_name"), "path", "clause_no", blank("text")).alias("retrieval_text"),
            F.coalesce("parent_text", "text").alias("context_text"),
            F.col("node_type").alias("chunk_type"),
        )
    )


def page_map(tree: DataFrame) -> DataFrame:
    return tree.filter("page_start > 0").select("standard_id", F.col("page_start").alias("page_no"), "node_id", F.lit("full").alias("coverage_type")).dropDuplicates(["standard_id", "page_no", "node_id"])


def table_owner(tables: DataFrame, tree: DataFrame) -> DataFrame:
    """tables (standard_id, page_no, ...) with node_id: the first node that begins on the table's page, else the standard."""
    first = tree.groupBy("standard_id", F.col("page_start").alias("page_no")).agg(F.min_by("node_id", "ord").alias("owner"))
    return tables.join(first, ["standard_id", "page_no"], "left").withColumn("node_id", F.coalesce("owner", "standard_id")).drop("owner")


def structure_tables(tables: DataFrame) -> DataFrame:
    """tables (standard_id, page_no, table_index, html) with table_id, rows and Markdown."""
    return tables.withColumn("table_id", F.concat_ws(":", "standard_id", F.lit("T"), "page_no", "table_index")).withColumn("rows", T.table_rows(F.col("html"))).withColumn("table_markdown", T.markdown_table(F.col("rows")))


def table_cells(structured: DataFrame) -> DataFrame:
    """One row for each cell below the first row and right of the first column, with its headers, number and unit (of numeric cells)."""
    rows = structured.select("table_id", F.col("rows")[0].alias("head"), F.posexplode("rows").alias("row_idx", "row")).filter("row_idx > 0")
    cells = rows.select("table_id", "row_idx", "head", F.col("row")[0].alias("row_header"), F.posexplode("row").alias("col_idx", "cell_text")).filter("col_idx > 0")
    header = F.coalesce(F.get("head", F.col("col_idx")), F.lit(""))
    number = T.first_number(F.col("cell_text"))
    return cells.select(
        "table_id", "row_idx", "col_idx", "row_header", header.alias("col_header"), "cell_text", number.alias("number_value"), F.when(number.isNotNull(), T.unit_from_header(header)).otherwise(F.lit("")).alias("unit")
    )


def parser_route(pages: DataFrame, key: list[str], is_pdf: Column, text: str = "text") -> DataFrame:
    """key, pages, avg_bytes, route: files that are no PDF or have under 100 bytes a page go to the layout parser."""
    stats = pages.groupBy(*key).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.octet_length(text)).alias("bytes"), F.first(is_pdf).alias("is_pdf"))
    average = F.expr("bytes div pages")
    return stats.select(*key, "pages", average.alias("avg_bytes"), F.when(~F.col("is_pdf"), "layout").when(average < 100, "layout").otherwise("text").alias("route"))


def quality_gate(reports: DataFrame) -> DataFrame:
    """reports (standard_no, clause_count, avg_ocr_confidence, ...) with issues and passed."""
    issues = F.array_compact(
        F.array(
            F.when(F.coalesce("standard_no", F.lit("")) == "", F.lit("standard_no_missing")),
            F.when(F.coalesce("clause_count", F.lit(0)) == 0, F.lit("no_clauses")),
            F.when(F.coalesce("avg_ocr_confidence", F.lit(0.0)) < 0.80, F.lit("low_ocr_confidence")),
        )
    )
    return reports.withColumn("issues", issues).withColumn("passed", F.size("issues") == 0)


def ingest_counts(clauses: DataFrame) -> DataFrame:
    """Clauses per document, repeated numbers counted."""
    return clauses.groupBy("doc_path").agg(F.count(F.lit(1)).alias("clause_count"))

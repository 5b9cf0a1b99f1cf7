"""Pages, layout-parser output, dictionaries and evaluation sets as DataFrames; the text dump."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

LAYOUT = "source_path string, title string, standard_no string, error string, elements array<struct<type:string,page_no:int,level:int,title:string,text:string,clause_no:string,table_html:string,caption:string,bbox:string,ocr_confidence:float>>"
CONTENT_ITEM = "array<struct<type:string,page_idx:int,text:string,text_level:int,table_body:string,table_caption:string>>"
EVAL = "question string, gold_standard_no string, gold_clause_no string, gold_answer string, gold_table_id string, must_cite boolean, should_answer boolean"


def pdf_pages(spark: SparkSession, path: str, extract: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """(doc_path, title, page_no, text) of files; `extract` gives the page texts of a file's bytes. Pages count from 1; a file that can't be read raises."""

    def run(frames) -> Iterator:
        import pandas as pd

        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                pages = list(extract(bytes(data)))
                yield pd.DataFrame({"doc_path": [name] * len(pages), "page_no": range(1, len(pages) + 1), "text": [p or "" for p in pages]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "doc_path string, page_no int, text string").withColumn("title", T.filename(F.col("doc_path")))


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_path, title, page_no, text) of text files with form feeds between pages."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_path"), "value")
    return whole.select("doc_path", T.filename(F.col("doc_path")).alias("title"), F.posexplode(F.split("value", "\f")).alias("p", "text")).select("doc_path", "title", (F.col("p") + 1).alias("page_no"), "text")


def layout_elements(documents: DataFrame, column: str = "json") -> DataFrame:
    """(source_path, title, standard_no, ord, type, page_no, level, ...) of layout-parser JSON. A document with an error raises; unknown types count as Text;
    a heading without a number gets that at its text's beginning."""
    parsed = documents.select(F.from_json(column, LAYOUT).alias("d"))
    checked = parsed.withColumn("d", F.when(F.col("d.error").isNotNull(), F.raise_error(F.concat(F.lit("layout parser: "), F.col("d.error")))).otherwise(F.col("d")))
    rows = checked.select(*[F.coalesce(f"d.{c}", F.lit("")).alias(c) for c in ("source_path", "title", "standard_no")], F.posexplode("d.elements").alias("ord", "e"))
    kind = F.when(F.col("e.type").isin("Heading", "Text", "Table", "Formula", "Figure"), F.col("e.type")).otherwise("Text")
    text = F.coalesce("e.text", F.lit(""))
    derived = T.clause_head_no(T.normalize_fullwidth(F.concat(F.coalesce("e.title", F.lit("")), F.lit(" "), text)))
    return rows.select(
        "source_path", "title", "standard_no", "ord", kind.alias("type"), F.coalesce("e.page_no", F.lit(0)).alias("page_no"), F.coalesce("e.level", F.lit(0)).alias("level"), F.coalesce("e.title", F.lit("")).alias("element_title"), text.alias("text"),
        F.when(F.coalesce("e.clause_no", F.lit("")) != "", F.col("e.clause_no")).when(kind == "Heading", derived).otherwise("").alias("clause_no"),
        F.coalesce("e.table_html", F.lit("")).alias("table_html"), F.coalesce("e.caption", F.lit("")).alias("caption"), F.coalesce("e.ocr_confidence", F.lit(1.0)).alias("ocr_confidence"),
    )


def content_list(documents: DataFrame, column: str = "json") -> DataFrame:
    """(doc_path, ord, type, level, page_no, text, table_html, caption) of content lists: tables, headings (text with a level) and text, page numbers from 1; other items are dropped."""
    items = documents.select("doc_path", F.posexplode(F.from_json(column, CONTENT_ITEM)).alias("ord", "i"))
    kind = F.when(F.col("i.type") == "table", "Table").when((F.col("i.type") == "text") & (F.coalesce("i.text_level", F.lit(0)) > 0), "Heading").when(F.col("i.type") == "text", "Text")
    return items.withColumn("kind", kind).filter("kind is not null").select("doc_path", "ord", F.col("kind").alias("type"), F.coalesce("i.text_level", F.lit(0)).alias("level"), (F.coalesce("i.page_idx", F.lit(0)) + 1).alias("page_no"), F.coalesce("i.text", F.lit("")).alias("text"), F.coalesce("i.table_body", F.lit("")).alias("table_html"), F.coalesce("i.table_caption", F.lit("")).alias("caption"))


def synonym_groups(lines: Iterable[str]) -> list[list[str]]:
    """Groups of comma-separated terms; # begins a comment, blanks are trimmed and dropped."""
    groups = ([t.strip() for t in line.split(",") if t.strip()] for line in lines if not line.lstrip().startswith("#"))
    return [g for g in groups if g]


def dictionary(lines: DataFrame, column: str = "line") -> DataFrame:
    """`lines` with terms, as synonym_groups() has them; lines without a term are dropped."""
    terms = F.filter(F.transform(F.split(column, ","), lambda t: F.trim(t)), lambda t: t != "")
    return lines.filter(~F.ltrim(column).startswith("#")).withColumn("terms", terms).filter(F.size("terms") > 0)


def user_terms(lines: Iterable[str]) -> list[str]:
    return [x for x in (line.strip() for line in lines) if x and not x.startswith("#")]


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON array; missing texts are empty, must_cite false, should_answer true."""
    return _cases(spark.read.schema(EVAL).json(path, multiLine=True))


def eval_cases_of(rows: DataFrame, column: str = "json") -> DataFrame:
    """eval_cases() of JSON arrays in a column, with the other columns."""
    return _cases(rows.select("*", F.explode(F.from_json(column, f"array<struct<{EVAL.replace(' ', ':')}>>".replace(",:", ", "))).alias("_c")).select(*[c for c in rows.columns if c != column], "_c.*"), [c for c in rows.columns if c != column])


def _cases(raw: DataFrame, others: list[str] | None = None) -> DataFrame:
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("question", "gold_standard_no", "gold_clause_no", "gold_answer", "gold_table_id")]
    return raw.select(*(others or []), *texts, F.coalesce("must_cite", F.lit(False)).alias("must_cite"), F.coalesce("should_answer", F.lit(True)).alias("should_answer"))


def dump_lines(pages: DataFrame) -> DataFrame:
    """(doc_path, page_no, value): each page under its rule, to be written as text."""
    return pages.select("doc_path", "page_no", F.format_string("===== 第 %d 页 =====\n%s", "page_no", "text").alias("value"))


def dump_sample(pages: DataFrame, key: str = "doc_path", most: int = 600) -> DataFrame:
    """key and sample: the first `most` bytes of the first page that isn't blank, as binary (a character may be cut)."""
    return pages.filter(~T.is_blank(F.col("text"))).groupBy(key).agg(F.min_by(F.substring(F.col("text").cast("binary"), 1, most), "page_no").alias("sample"))


def dump_stats(pages: DataFrame, key: str = "doc_path") -> DataFrame:
    """key, pages, bytes and the first page that isn't blank."""
    shown = F.when(~T.is_blank(F.col("text")), F.col("page_no"))
    return pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.octet_length("text")).alias("bytes"), F.min(shown).alias("first_page"))


def vectors(rows: DataFrame, dim: int) -> DataFrame:
    """Vector rows of one dimension, one for each node; another dimension raises."""
    checked = rows.withColumn("dense", F.when(F.size("dense") == dim, F.col("dense")).otherwise(F.raise_error(F.format_string("dimension %d", F.size("dense")))))
    return checked.dropDuplicates(["node_id"])


def first_embedding(responses: DataFrame, column: str = "json") -> DataFrame:
    """embedding: that of the first item of each response."""
    return responses.withColumn("embedding", F.from_json(column, "data array<struct<embedding:array<float>,index:int>>, model string")["data"][0]["embedding"])

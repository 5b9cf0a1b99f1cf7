"""Text functions for clauses, standard numbers, tables and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grammars and word lists that results depend on.
FULL_WIDTH, HALF_WIDTH = "　０１２３４５６７８９．", " 0123456789."
CLAUSE_HEAD = r"^\s*(\d+(?:\.\d+){1,3}(?:-[0-9a-zA-Z]+)?)\s+(.*)$"
CHAPTER_HEAD = r"^\s*第?(\d{1,2})\s*章?\s+([^\d\s][^\d]{0,29})$"
STANDARD_NO = r"[A-Z]{2,}(?:/[A-Z]+)?[ \t]*[A-Z]{0,2}\d+(?:\.\d+)?-(?:19|20)\d{2}"
FAMILIES = "GB|JTG|JTJ|TB|JGJ|CJJ|DL|SL|YB"
STANDARD_FAMILY = rf"({FAMILIES})(/T)?\s*([A-Z]?\d{{2,5}})(-\d{{4}})?"
VALID_CLAUSE = r"^\d+(\.\d+){1,3}(-[0-9a-zA-Z]+)?$"
CLAUSE_IN_TEXT = r"\d+(?:\.\d+){1,3}(?:-[0-9a-zA-Z]+)?"
TABLE_INTENT = "表|限值|指标|单位|数值|取值|不应小于|不应大于"
REFUSALS = "无法作答|未检索到|无法从规范|拒答|未能准确生成"
NUMBER = r"(-?\d+(?:\.\d+)?)\s*(%|[A-Za-z]+|‰)?"
CURRENT, RETIRED, COMING, REVISED = "现行", "作废", "即将实施", "被修订"
PUBLIC, ADMIN = "public", "admin"


def filename(path: Column) -> Column:
    """What follows the last slash or backslash; the whole path if there is none."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(filename(path), r"(?<=.)\.[^.]*$", "")


def is_pdf(path: Column) -> Column:
    return path.rlike(r"\.(pdf|PDF)$")


def make_id(text: Column) -> Column:
    """A portable id of a text (a path, a name): decimal digits."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10)


def normalize_fullwidth(text: Column) -> Column:
    """Full-width space, digits and full stop as ASCII; all else unchanged."""
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^ \t\r\n]")


def clause_head_no(line: Column) -> Column:
    """The clause number that a line begins with, '' if it is no head (a number of two to four levels, then space)."""
    return F.regexp_extract(line, CLAUSE_HEAD, 1)


def clause_head_text(line: Column) -> Column:
    return F.regexp_extract(line, CLAUSE_HEAD, 2)


def extract_standard_no(text: Column, fallback: Column) -> Column:
    """The first standard number with a year, or the fallback."""
    found = F.regexp_extract(text, STANDARD_NO, 0)
    return F.when(found != "", found).otherwise(fallback)


def find_standard_no(text: Column) -> Column:
    """The first number of a known family, normalised; '' if there is none. The year may be missing."""
    return normalize_standard_no(F.regexp_extract(text, STANDARD_FAMILY, 0))


def normalize_standard_no(number: Column) -> Column:
    """One space between prefix and number, white space collapsed and trimmed."""
    spaced = F.regexp_replace(number, rf"^\s*((?:{FAMILIES})(?:/T)?|[A-Z]{{2,}}(?:/T)?)\s*([A-Z]?\d)", "$1 $2")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def is_valid_clause_no(number: Column) -> Column:
    return number.rlike(VALID_CLAUSE)


def parent_clause_no(number: Column) -> Column:
    """Without the last dotted part; '' for a chapter."""
    return F.regexp_extract(number, r"^(.*)\.[^.]*$", 1)


def node_type(number: Column) -> Column:
    dots = F.size(F.split(number, r"\.")) - 1
    return F.when(number.contains("-"), "item").when(dots == 0, "chapter").when(dots == 1, "section").otherwise("clause")


def wants_table(question: Column) -> Column:
    return question.rlike(TABLE_INTENT)


def numbers(text: Column) -> Column:
    """array<struct<value double, unit string, raw string>> of all numbers with their units."""
    raw, value, unit = (F.regexp_extract_all(text, F.lit(NUMBER), F.lit(k)) for k in (0, 1, 2))
    return F.transform(F.arrays_zip(value.alias("v"), unit.alias("u"), raw.alias("r")), lambda x: F.struct(x["v"].cast("double").alias("value"), x["u"].alias("unit"), x["r"].alias("raw")))


def unverified_numbers(answer: Column, source: Column, tolerance: float = 1e-9) -> Column:
    """Numbers of the answer without an equal number of a compatible unit (equal, or one is missing) in the source."""
    known = numbers(source)
    return F.filter(numbers(answer), lambda a: ~F.exists(known, lambda s: (F.abs(s["value"] - a["value"]) <= tolerance) & ((s["unit"] == a["unit"]) | (s["unit"] == "") | (a["unit"] == ""))))


def _escaped(literal: Column) -> Column:
    return F.regexp_replace(literal, r"([\\^$.|?*+()\[\]{}\-])", r"\\$1")


def cites_clause(answer: Column, clause_no: Column, strict: bool = False) -> Column:
    """Whether the clause number stands in the answer, no digit after it. strict: not as part of a longer number either."""
    left, right = (r"(?<![\d.])", r"(?!\d|\.\d)") if strict else ("", r"(?!\d)")
    pattern = F.concat(F.lit(left), _escaped(clause_no), F.lit(right))
    return F.when(clause_no == "", F.lit(False)).otherwise(F.regexp_like(answer, pattern))


def is_refusal(answer: Column) -> Column:
    return answer.rlike(REFUSALS)


def refusal_correct(should_answer: Column, refused: Column) -> Column:
    return should_answer != refused


def recall_at(ranked: Column, gold: Column, k: int) -> Column:
    """1 if gold is among the first k, else 0."""
    return F.coalesce(F.array_position(ranked, gold).between(1, k), F.lit(False)).cast("int")


def reciprocal_rank(ranked: Column, gold: Column) -> Column:
    at = F.array_position(ranked, gold)
    return F.when(at > 0, 1.0 / at).otherwise(F.lit(0.0))


def table_rows(html: Column) -> Column:
    """array<array<string>>: trimmed cell texts of each row, tags removed. Rows may span lines."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda row: F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(cells(r), lambda c: F.trim(F.regexp_replace(c, r"(?s)<[^>]+>", ""))))


def unit_from_header(header: Column) -> Column:
    """What stands in the first round brackets, ASCII or full-width."""
    return F.regexp_extract(header, "[(（]([^)）]+)[)）]", 1)


def first_number(text: Column) -> Column:
    """The first number in a text, null if there is none."""
    found = F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0)
    return F.when(found != "", found.cast("double"))


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table; a rule follows the first row."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = lambda r: F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(r)))
    return F.array_join(F.flatten(F.transform(rows, lambda r, k: F.when(k == 0, F.array(line(r), rule(r))).otherwise(F.array(line(r))))), "\n")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a run of CJK characters gives its bigrams (a single one itself)."""
    runs = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    cjk = r"^[\p{IsHan}]+$"
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda k: F.substring(t, k, F.lit(2)))
    split = F.flatten(F.transform(runs, lambda t: F.when(t.rlike(cjk) & (F.length(t) > 2), pairs(t)).otherwise(F.array(t))))
    return F.when(text.rlike(r"\p{IsHan}{3}"), split).otherwise(runs)  # most texts need no second look

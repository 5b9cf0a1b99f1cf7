"""Context fragments, prompts and answers."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Messages and prompt texts.
NO_CANDIDATES = "未检索到相关规范依据，无法作答。"
NO_SOURCE = "检索命中但回查规范原文为空，无法作答。"
NOT_VERIFIED = "未能准确生成，以下为规范原文："
PARENT_MARK = "\n【父级上下文】"
SYSTEM_PROMPT = """你是规范条文检索助手。严格遵守：
1. 只能依据提供的检索上下文回答，不得编造；
2. 回答必须标明标准号、标准名称、条款号；
3. 涉及强制性条文必须提示；
4. 涉及废止/非现行标准必须提示；
5. 若上下文为空或不足以支撑，必须明确拒答，提示未检索到依据；
6. 不得编造条款号、限值、单位。
引用格式示例：依据《标准名称》（标准号）第 X.X.X 条……"""
QUESTION_MARK, CONTEXT_MARK = "【用户问题】\n", "\n\n【检索上下文（JSON 数组）】\n"
CLOSING = "\n\n请依据上述上下文作答，并按要求标注来源；若不足以作答请拒答。"


def fragments(candidates: DataFrame, clauses: DataFrame, standards: DataFrame) -> DataFrame:
    """Authoritative fragments of candidates (question_id, clause_id, rank): text and status come from the tables, not from the index.

    A candidate without a clause is dropped and the numbering closes up; a missing standard gives empty fields.
    """
    own = clauses.select("clause_id", "standard_id", "clause_no", "path", "text")
    std = standards.select("standard_id", "standard_no", "standard_name", "status")
    met = candidates.select("question_id", "clause_id", "rank").join(own, "clause_id").join(std, "standard_id", "left")
    order = Window.partitionBy("question_id").orderBy("rank", "clause_id")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return met.select(
        "question_id",
        F.row_number().over(order).alias("ord"),
        F.concat(F.lit("S"), F.row_number().over(order)).alias("source_id"),
        "clause_id",
        *[empty(c) for c in ("standard_no", "standard_name", "status", "clause_no", "path", "text")],
        F.lit(False).alias("is_mandatory"),
        F.array().cast("array<string>").alias("tables"),
        F.array().cast("array<string>").alias("formulas"),
    )


FIELDS = ["clause_no", "formulas", "is_mandatory", "path", "source_id", "standard_name", "standard_no", "status", "tables", "text"]


def fragment_json() -> Column:
    """A fragment as JSON with its keys in alphabetical order."""
    return F.to_json(F.struct(*FIELDS))


def indented_json() -> Column:
    """fragment_json() as an item of a JSON array with an indent of two spaces."""
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    items = lambda c: F.transform(c, lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1))
    listed = lambda c: F.when(F.size(c) == 0, "[]").otherwise(F.concat(F.lit("[\n      "), F.array_join(items(c), ",\n      "), F.lit("\n    ]")))
    value = {"formulas": listed("formulas"), "tables": listed("tables"), "is_mandatory": F.col("is_mandatory").cast("string")}
    lines = [F.concat(F.lit(f'    "{c}": '), value.get(c, quoted(c))) for c in FIELDS]
    return F.concat(F.lit("  {\n"), F.concat_ws(",\n", *lines), F.lit("\n  }"))


def context_json(rows: DataFrame, indent: bool = False) -> DataFrame:
    """(question_id, n_fragments, context): the fragments of each question as a JSON array in order; with `indent`, as prompts show it."""
    listed = rows.select("question_id", "ord", (indented_json() if indent else fragment_json()).alias("j")).groupBy("question_id").agg(F.count(F.lit(1)).alias("n_fragments"), F.array_sort(F.collect_list(F.struct("ord", "j"))).alias("js"))
    first, between, last = ("[\n", ",\n", "\n]") if indent else ("[", ",", "]")
    return listed.select("question_id", "n_fragments", F.concat(F.lit(first), F.array_join(F.transform("js", lambda x: x["j"]), between), F.lit(last)).alias("context"))


def prompts(questions: DataFrame, candidates: DataFrame, contexts: DataFrame) -> DataFrame:
    """(question_id, system_prompt, user_prompt, refusal): refusal is set, and prompts are null, where nothing was recalled or nothing could be looked up."""
    recalled = candidates.select("question_id").distinct().withColumn("recalled", F.lit(True))
    met = questions.select("question_id", "question").join(recalled, "question_id", "left").join(contexts, "question_id", "left")
    user = F.concat(F.lit(QUESTION_MARK), "question", F.lit(CONTEXT_MARK), "context", F.lit(CLOSING))
    refusal = F.when(F.col("recalled").isNull(), NO_CANDIDATES).when(F.col("context").isNull(), NO_SOURCE)
    return met.select("question_id", F.when(F.col("context").isNotNull(), F.lit(SYSTEM_PROMPT)).alias("system_prompt"), user.alias("user_prompt"), refusal.alias("refusal"))


def small_to_big(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fragments with the chunk's context text added where there is one and it differs. Of several chunks the smallest id counts."""
    context = chunks.groupBy(F.col("node_id").alias("clause_id")).agg(F.min_by("context_text", "chunk_id").alias("context_text"))
    more = F.coalesce("context_text", F.lit(""))
    return rows.join(context, "clause_id", "left").withColumn("text", F.when((more != "") & (more != F.col("text")), F.concat("text", F.lit(PARENT_MARK), more)).otherwise(F.col("text"))).drop("context_text")


def budget(pieces: DataFrame, limit: int) -> DataFrame:
    """Pieces (question_id, priority, ord, text) that fit: by priority and order while the running length is within the limit; priority 1 always stays."""
    order = Window.partitionBy("question_id").orderBy("priority", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumn("running", F.sum(F.length("text")).over(order)).filter((F.col("running") <= limit) | (F.col("priority") == 1))


class Generator(Protocol):
    """Turns prompts into answers: (question_id, system_prompt, user_prompt, refusal) and fragments to (question_id, answer)."""

    def generate(self, asked: DataFrame, rows: DataFrame) -> DataFrame: ...


class ExtractiveGenerator:
    """Quotes the first fragment in the citation format; needs no service."""

    def generate(self, asked: DataFrame, rows: DataFrame) -> DataFrame:
        first = rows.filter("ord = 1").select("question_id", F.format_string("依据《%s》（%s）第 %s 条：%s", "standard_name", "standard_no", "clause_no", "text").alias("quoted"))
        return asked.select("question_id", "refusal").join(first, "question_id", "left").select("question_id", F.coalesce("refusal", "quoted").alias("answer"))


def intercept_numbers(answers: DataFrame, rows: DataFrame, strict: bool = False) -> DataFrame:
    """answers (question_id, answer) with all_verified and final: an answer with a number that the fragments lack is replaced by their text.

    strict compares with the clause texts alone; otherwise standard and clause numbers count as sources too.
    """
    body = F.col("text") if strict else F.concat_ws(" ", "text", "clause_no", "standard_no")
    sources = rows.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", body.alias("b"), "text"))), lambda x: x["b"]), "\n").alias("source"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("quoted"))
    met = answers.join(sources, "question_id", "left")
    bad = T.unverified_numbers(F.col("answer"), F.coalesce("source", F.lit("")))
    fine = (F.size(bad) == 0) | T.is_refusal(F.col("answer"))
    return met.select("question_id", "answer", fine.alias("all_verified"), F.when(fine, F.col("answer")).otherwise(F.concat(F.lit(NOT_VERIFIED), F.coalesce("quoted", F.lit("")))).alias("final"))


def answer(questions: DataFrame, candidates: DataFrame, clauses: DataFrame, standards: DataFrame, chunks: DataFrame | None = None, generator: Generator | None = None) -> DataFrame:
    """(question_id, answer, all_verified, final) for recalled candidates."""
    rows = fragments(candidates, clauses, standards)
    if chunks is not None:
        rows = small_to_big(rows, chunks)
    asked = prompts(questions, candidates, context_json(rows, indent=True))
    return intercept_numbers((generator or ExtractiveGenerator()).generate(asked, rows), rows)

"""A corpus from raw documents: quality rules, language ID, near-duplicates, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; run() writes each result as Parquet
to the shared folder of spark.checkpoint.dir and reads it again for the next. What a stage left there is dropped
once its result is no longer held and another one begins. Rows are told by themselves: null and repeated ids, null texts and other columns of
any name pass through the stages as each operator states it; empty tables give empty tables.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from clausemill.llm import decontaminate, langid, mixing, near_dups, quality
from clausemill.llm.common import Scratch, read


#: Tables and broadcasts of stages, each with what the stage returned.
_OPEN: list[tuple[Scratch, weakref.ref]] = []


def staged(make: Callable[[SparkSession, DataFrame, str, Scratch], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage with a scratch of its own. Those of earlier stages are closed if nobody holds their results and `docs` isn't read from them."""

    @wraps(make)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles() if _OPEN else []
        for entry in list(_OPEN):
            if entry[1]() is None and not any(entry[0].root.split("/")[-1] in f for f in files):
                _OPEN.remove(entry)
                if entry[0].spark is spark:
                    entry[0].close()
        scratch = Scratch(spark, f"pipeline-{make.__name__}")
        out = make(spark, docs, sf_dir, scratch)
        _OPEN.append((scratch, weakref.ref(out)))
        return out

    return stage


@staged
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch) -> DataFrame:
    """Documents that the rules and perplexity bands keep. Without words: none is kept."""
    return quality.passing(docs, scratch)


@staged
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch) -> DataFrame:
    """Documents whose language is told; the column lang stays as it is. Texts without a letter go."""
    return langid.passing(docs, scratch)


@staged
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch) -> DataFrame:
    """One document of each group (five-word shingles, similarity 0.8), that of the smallest id. Rows without an id or words stay."""
    return near_dups.survivors(docs, width=5, percent=80, scratch=scratch)


@staged
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch) -> DataFrame:
    """Documents without a word inside an occurrence of a benchmark window. Rows without text stay."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), scratch)


@staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch) -> DataFrame:
    """What the mix takes of each document. Null source: a source of its own."""
    return mixing.mix(docs, scratch=scratch).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix_sources),
]

#: Perplexity models and MinHash aren't SQL; the tests hold run() against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.put(docs, f"stage-{k}")
            scratch.drop_all_but(f"stage-{k}")
    return docs

"""Language identification by interpolated Kneser-Ney character models.

One model per language, counted by Spark over learning rows; the language of the lowest cross-entropy a character wins. The rejection limit is
calibrated on labelled rows that aren't learnt from (fold CALIBRATION of the ids): a text is rejected if its winner's cross-entropy lies beyond
the median of that winner's calibration rows of similar length by REJECT robust deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kneser_ney as kn
from .common import Scratch, fold_of, held_out, released, spread, wrapped

UNKNOWN = "und"
CALIBRATION = 1
REJECT, LEAST_DEVIATION = 16.0, 0.02
#: Calibration rows that a class of lengths (powers of two) needs for a limit of its own; others take the language's.
LEAST_ROWS = 30
#: Characters whose evidence the score takes as independent at most; longer texts aren't surer than that.
EVIDENCE = 40.0

SUMS = "struct<length:bigint,sums:array<double>>"
_KIND = pa.struct([("length", pa.int64()), ("sums", pa.list_(pa.float64()))])
ASCII_LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def lettered(text: bytes) -> bool:
    """Whether a text has a letter."""
    return not ASCII_LETTERS.isdisjoint(text) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def learning(docs: DataFrame) -> DataFrame:
    """Labelled rows that aren't held out."""
    return docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())


def calibrating() -> Column:
    return F.coalesce(fold_of(F.col("doc_id")) == CALIBRATION, F.lit(False))


def model_of(docs: DataFrame, scratch: Scratch) -> kn.Model:
    """Learns from text and non-null lang of rows that are neither held out nor calibrated on."""
    rows = learning(docs).filter(~calibrating()).select(F.col("lang").cast("string").alias("grp"), "text")
    return kn.estimated(scratch.put(kn.counted(rows, lower=True), "grams"), scratch, "language")


def summed(scratch: Scratch, model: kn.Model, shard: int):
    """A column function of text: number of characters, and their summed log-probabilities under each language; null without a letter."""
    scratch.settle()
    shared = scratch.share(model.shard(shard))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = kn.Scorer(shared.value, every=True)
        for texts in batches:
            rows: list[tuple[int, list[float]] | None] = []
            for part in kn.in_parts(texts):
                streams = [kn.stream(text, lower=True) if text and lettered(text) else "" for text in part]
                total = scorer.totals(streams)
                rows += [{"length": len(s), "sums": t} if s else None for s, t in zip(streams, total.tolist(), strict=True)]
            yield pa.array(rows, _KIND)
        released()

    return F.arrow_udf(run, SUMS, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()  # lest a filter evaluates it again


def scored(docs: DataFrame, model: kn.Model, scratch: Scratch) -> DataFrame:
    """(row, lang_pred, score, entropy): each row of `docs` (with text) as a struct, its language, the language's probability from 0 to 1 and its cross-entropy a character.

    A model of one shard, as all small ones, is applied as the result is read; further shards take a pass each, which is written.
    """
    rows = wrapped(docs)
    for k in range(model.shards):
        own = summed(scratch, model, k)(F.col("row.text").cast("string"))
        both = F.zip_with("s.sums", "next.sums", lambda x, y: x + y)
        rows = rows.withColumn("s", own) if k == 0 else rows.withColumn("next", own).withColumn("s", F.when(F.col("s").isNotNull(), F.struct(F.col("s.length").alias("length"), both.alias("sums")))).drop("next")
        if model.shards > 1:
            rows = scratch.put(rows, f"sums-{k}")
            scratch.unshare()
            scratch.drop(*[f"sums-{k - 1}"] if k else [])
    entropy = F.transform("s.sums", lambda x: -x / F.col("s.length"))
    best = F.array_min("each")  # at a tie, the first language in code point order
    odds = F.aggregate("each", F.lit(0.0), lambda s, x: s + F.exp(-(x - best) * F.least(F.col("s.length").cast("double"), F.lit(EVIDENCE))))
    names = F.array(*[F.lit(g) for g in model.groups]) if model.groups else F.array().cast("array<string>")
    told = rows.withColumn("each", entropy)
    known = F.col("s").isNotNull() & (F.size("each") > 0)
    return told.select(
        "row",
        F.when(known, F.element_at(names, F.array_position("each", best).cast("int"))).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, 1 / odds).otherwise(0.0).alias("score"),
        F.when(known, best).alias("entropy"),
        F.when(known, F.least(F.floor(F.log2("s.length")), F.lit(20))).cast("int").alias("size_class"),
    )


def limits_of(docs: DataFrame, model: kn.Model, scratch: Scratch) -> DataFrame:
    """(limit_lang, limit_class, limit_entropy): of each language and class of lengths; class -1 holds for all others."""
    own = scored(learning(docs).filter(calibrating()).select("lang", "text"), model, scratch)
    rows = scratch.put(own.filter("entropy is not null and lang_pred = row.lang").select("lang_pred", "size_class", "entropy"), "calibration")
    both = rows.unionByName(rows.withColumn("size_class", F.lit(-1)))
    middle = both.groupBy("lang_pred", "size_class").agg(F.percentile_approx("entropy", 0.5, 10000).alias("middle"), F.count(F.lit(1)).alias("n"))
    middle = middle.filter((F.col("n") >= LEAST_ROWS) | (F.col("size_class") == -1))
    apart = both.join(F.broadcast(middle), ["lang_pred", "size_class"]).groupBy("lang_pred", "size_class", "middle").agg(F.percentile_approx(F.abs(F.col("entropy") - F.col("middle")), 0.5, 10000).alias("apart"))
    limit = F.col("middle") + REJECT * F.greatest(1.4826 * F.col("apart"), LEAST_DEVIATION * F.col("middle"))
    return scratch.put(apart.select(F.col("lang_pred").alias("limit_lang"), F.col("size_class").alias("limit_class"), limit.alias("limit_entropy")), "limits")


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """scored() rows with rejected. The limits, some rows a language, are broadcast."""
    own, rest = limits.filter("limit_class >= 0"), limits.filter("limit_class = -1").select(F.col("limit_lang").alias("rest_lang"), F.col("limit_entropy").alias("rest_entropy"))
    met = rows.join(F.broadcast(own), (F.col("lang_pred") == F.col("limit_lang")) & (F.col("size_class") == F.col("limit_class")), "left").join(F.broadcast(rest), F.col("lang_pred") == F.col("rest_lang"), "left")
    over = F.coalesce(F.col("entropy") > F.coalesce("limit_entropy", "rest_entropy"), F.lit(False))  # without calibration rows, there is nothing to hold it against
    return met.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | over)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of `docs` (doc_id, text, lang).

    Null text and text without a letter: `und`, score 0, rejected. The same goes for all rows if no row teaches a language. Null lang:
    not learnt from, but predicted. Null doc_id: learnt from. Repeated rows each count; at a tie the first language in code point order wins. Other columns are
    ignored. No rows: no rows. Every language is scored, so time grows with their number; memory doesn't.
    """
    scratch, narrow = Scratch(docs.sparkSession, "langid"), spread(docs.select("doc_id", "text", "lang"))
    model = model_of(narrow, scratch)
    limits = limits_of(narrow, model, scratch)
    return judged(scored(narrow.select("doc_id", "text"), model, scratch), limits).select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def passing(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of `docs` that identify() doesn't reject, with all their columns, whatever their names.

    Nulls, empty texts, repeated rows and empty tables are treated as in identify(); rows are told by themselves, not by doc_id. The broadcast
    models live until `scratch` is closed.
    """
    scratch = scratch or Scratch(docs.sparkSession, "langid")
    model = model_of(docs, scratch)
    limits = limits_of(docs, model, scratch)
    return judged(scored(docs, model, scratch), limits).filter("not rejected").select("row.*")

"""Mixing sources to target weights, in DataFrame functions alone.

Every document gets a hash-random key. Within its source, documents are ordered by that key; the key's
leading bits deal each source into ranges, so a hot source spreads over many tasks. Sums per range are
prefix-summed over the ranges of a source, running sums inside a range complete them, and each source is cut at its
exact budget after as many whole epochs as the budget holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, word_count

#: Key ranges of a source. A source of 4 billion documents has a million in each.
RANGES = 4096
KEY_HEX, RANGE_HEX = 15, 3


def random_key(doc_id: Column, seed: str) -> Column:
    """60 bits of md5(seed + doc_id); equal in every run and engine."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_HEX), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """(source, source_size) with weight, target and budget.

    A target is its weight's share of the whole, at most `most` times the source's size; what is above goes to the others
    by weight. That is one water level: with sources ordered by cap over weight, the level that fits after the
    first k are full rises as long as the next one is full too, so the level is the largest of these.
    One row a source: the windows run over the list of sources, not over documents.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    weighed = totals.withColumn("weight", pick.cast("long"))
    filled = Window.orderBy((F.col("source_size") * most / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))) / F.sum("weight").over(rest)
    return (
        weighed.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least((F.col("source_size") * most).cast("double"), F.col("weight") * F.col("level")))
        .withColumn("budget", F.round("target").cast("long"))
        .select("source", "source_size", "weight", "target", "budget")
    )


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix-1", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, weight, taken, epochs for each row of `docs` (doc_id, text, source).

    `epochs` counts whole passes over the source; `taken` adds the words taken in the last, cut pass.
    Null or empty text: size 0 and nothing taken. Null source: a source of its own, last. Null ids share one key.
    Equal rows: each is a document. No rows: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), seed).alias("key"))
    sized = (scratch or Scratch(spark, "mix")).put(narrow, "sized").withColumn("range", F.shiftright("key", 4 * (KEY_HEX - RANGE_HEX)))
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    in_source = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(in_source), F.lit(0)))
    totals = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(totals, weights, most)
    plan = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "o.range", "o.offset", "t.source_size", "t.weight", "t.target", "t.budget")
    in_range = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    running = sized.withColumn("running", F.coalesce(F.sum("size").over(in_range), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long")
    left = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("offset") - F.col("running")
    return (
        running.alias("d")
        .join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.range") == F.col("p.range")))
        .select("d.doc_id", "d.source", "d.size", "d.running", "p.offset", "p.source_size", "p.target", "p.weight", "p.budget")
        .withColumn("epochs", whole)
        .withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left)))
        .select("doc_id", "source", "size", "source_size", "target", "weight", "taken", "epochs")
    )

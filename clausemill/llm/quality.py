"""Quality rules with n-gram perplexity bands.

Spark counts character n-grams, which run on across words, by language; modified Kneser-Ney models of these stand in sorted hash arrays. A
document is scored by its own language, and its cross-entropy (log-perplexity) a character is held against the language's band: the median of
the language's documents, plus and minus WIDTH robust deviations. Models and bands are of documents that pass the base rules and have few
marks (ODD_PERCENT), so that junk neither teaches the model nor widens the band; a language without such documents takes those that pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kneser_ney as kn
from .common import Scratch, released, spread, wrapped

MIN_WORDS, MAX_REPEATED_PERCENT, REPEAT_WINDOW = 50, 50, 3
MARKS = b"#*$%&|<>"
WIDTH = 10.0
#: Marks to a hundred words, beyond which a document doesn't count for models and bands. It is scored like all others.
ODD_PERCENT = 10
#: A robust deviation is taken as this share of the median at least, so that a language that consists of copies keeps a band.
LEAST_DEVIATION = 0.01

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURED = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,length:bigint,total:double>"
_KIND = pa.struct([*[(name, pa.int64()) for name in [*METRICS, "length"]], ("total", pa.float64())])


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of REPEAT_WINDOW that occur twice or more."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key, room = ids[:n], len(number)
    for k in range(1, REPEAT_WINDOW):
        if room > (1 << 62) // len(number):  # the next word's number wouldn't fit: number the windows so far anew
            key, room = np.unique(key, return_inverse=True)[1], n
        key, room = key * len(number) + ids[k : k + n], room * len(number)
    _, key = np.unique(key, return_inverse=True)
    again = np.bincount(key)[key] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += again
    edge[REPEAT_WINDOW:] -= again
    return int((np.cumsum(edge)[:-1] > 0).sum())


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def base_metrics(text: bytes | None) -> tuple[tuple[int, ...], str]:
    """METRICS of a text, and its words as a stream."""
    words = text.split() if text else []
    if not words:
        return (0, 0, 0, 0, 0), ""
    stream = kn.stream(text, lower=False)
    symbols = len(text) - len(text.translate(None, MARKS))
    return (len(words), len(stream) - len(words), symbols, dup_lines(text), repeated_words(words)), stream


def fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words


def counted(docs: DataFrame) -> DataFrame:
    """(grp, odd, gram, n) of the documents of (grp string, text string) that pass the base rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = kn.Tally()

        def sent() -> Iterator[pa.RecordBatch]:
            for (group, odd), grams, n in tally.batches():
                yield pa.record_batch([pa.array([group] * len(n), pa.string()), pa.array([odd] * len(n), pa.bool_()), pa.array(grams.tolist(), pa.string()), pa.array(n, pa.int64())], ["grp", "odd", "gram", "n"])

        for batch in batches:
            groups, at = batch.column(0).to_pylist(), 0
            for part in kn.in_parts(batch.column(1)):
                streams: dict[tuple[str, bool], list[str]] = {}
                for group, text in zip(groups[at : at + len(part)], part, strict=True):
                    m, stream = base_metrics(text)
                    if not fails(m[0], m[4]):
                        streams.setdefault((group, 100 * m[2] > ODD_PERCENT * m[0]), []).append(stream)
                at += len(part)
                for key, own in streams.items():
                    tally.add(key, own)
                if tally.size > kn.COUNTED:
                    yield from sent()
        yield from sent()
        released()

    return docs.mapInArrow(run, "grp string, odd boolean, gram string, n long").groupBy("grp", "odd", "gram").agg(F.sum("n").alias("n"))


def language(row: str = "") -> Column:
    """The group of a row's language; null is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"{row}lang").cast("string")), F.lit(""))


def measure(scratch: Scratch, model: kn.Model, shard: int, first: bool):
    """A column function of (group, text): METRICS, length and the summed log-probability of a shard's characters; without `first`, the sum alone."""
    scratch.settle()
    shared, groups = scratch.share(model.shard(shard)), list(model.groups)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scorer, number = kn.Scorer(shared.value, every=False), {g: k for k, g in enumerate(groups)}
        for langs, texts in batches:
            rows: list[tuple] = []
            names, at = langs.to_pylist(), 0
            for part in kn.in_parts(texts):
                found = [base_metrics(text) if first else ((), kn.stream(text, lower=False)) for text in part]
                group = np.array([number.get(g, -1) for g in names[at : at + len(part)]], np.int64)
                at += len(part)
                known = np.flatnonzero([g >= 0 and bool(s) for g, (_, s) in zip(group, found, strict=True)])
                total = np.full(len(part), np.nan)
                if len(known):
                    total[known] = scorer.totals([found[k][1] for k in known], group[known])[:, 0]
                rows += [(*m, len(s), t) for (m, s), t in zip(found, total.tolist(), strict=True)]
            totals = pa.array([None if r[-1] != r[-1] else r[-1] for r in rows], pa.float64())
            yield pa.StructArray.from_arrays([*[pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], totals], fields=list(_KIND)) if first else totals
        released()

    return F.arrow_udf(run, MEASURED if first else "double", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()  # lest a filter evaluates it again


def base_failed() -> Column:
    return (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > MAX_REPEATED_PERCENT * F.col("m.n_words"))


def odd() -> Column:
    return 100 * F.col("m.n_symbols") > ODD_PERCENT * F.col("m.n_words")


def model_of(docs: DataFrame, scratch: Scratch) -> tuple[kn.Model, list[str]]:
    """The model of `docs` (lang, text), and the languages that have odd documents only."""
    counts = scratch.put(counted(docs.select(language().alias("grp"), F.col("text").cast("string").alias("text"))), "grams")
    plain = {r["grp"]: r["plain"] for r in counts.groupBy("grp").agg(F.bool_or(~F.col("odd")).alias("plain")).collect()}
    only_odd = sorted(g for g, p in plain.items() if not p)
    return kn.estimated(counts.filter(~F.col("odd") | F.col("grp").isin(only_odd)).drop("odd"), scratch, "quality"), only_odd


def bands(entropies: DataFrame) -> DataFrame:
    """(band_lang, low, high) of (grp, entropy); one row a language."""
    own = entropies.filter("entropy is not null").select(F.col("grp").alias("band_lang"), "entropy")
    middle = own.groupBy("band_lang").agg(F.percentile_approx("entropy", 0.5, 10000).alias("middle"))
    apart = own.join(F.broadcast(middle), "band_lang").groupBy("band_lang", "middle").agg(F.percentile_approx(F.abs(F.col("entropy") - F.col("middle")), 0.5, 10000).alias("apart"))
    reach = WIDTH * F.greatest(1.4826 * F.col("apart"), LEAST_DEVIATION * F.col("middle"))
    return apart.select("band_lang", (F.col("middle") - reach).alias("low"), (F.col("middle") + reach).alias("high"))


def _judged(docs: DataFrame, scratch: Scratch, keep: Column) -> DataFrame:
    """(row, m, grp, entropy, low, high, base_failed, kept): `keep` of each row of `docs` with its measures and verdict, each text scored once."""
    model, only_odd = model_of(docs, scratch)
    rows = wrapped(docs)
    for k in range(model.shards):
        own = measure(scratch, model, k, first=k == 0)(language("row."), F.col("row.text").cast("string"))
        rows = rows.withColumn("m", own) if k == 0 else rows.withColumn("m", F.col("m").withField("total", F.col("m.total") + own))
        last = k == model.shards - 1
        rows = scratch.put(rows.select(keep.alias("row"), language("row.").alias("grp"), "m") if last else rows, f"measured-{k}")
        scratch.unshare()
        scratch.drop_all_but(f"measured-{k}", *[n for n in scratch.names if n.startswith("quality-order")])
    rows = rows.withColumn("entropy", -F.col("m.total") / F.col("m.length"))
    limits = scratch.put(bands(rows.filter(~base_failed() & (~odd() | F.col("grp").isin(only_odd)))), "bands")
    met = rows.join(F.broadcast(limits), rows["grp"] == limits["band_lang"], "left").drop("band_lang")
    scratch.drop_all_but(f"measured-{model.shards - 1}", "bands")
    inside = F.coalesce(F.col("entropy").between(F.col("low"), F.col("high")), F.lit(False))
    return met.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside)


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, entropy, low, high for each row of `docs` (doc_id, lang, text).

    Null or empty text: no words, base_failed, not kept. Null lang: a language of its own. Models and bands are of documents that
    pass the base rules; a document whose language has none of these isn't kept either, as it then failed them. Repeated
    rows each count, ties make no difference, other columns are ignored. No rows: no rows. The bands, one row a language, are broadcast.
    """
    rows = _judged(spread(docs.select("doc_id", "lang", "text")), Scratch(docs.sparkSession, "quality"), F.col("row.doc_id"))
    return rows.select(F.col("row").alias("doc_id"), *[F.col(f"m.{m}").alias(m) for m in METRICS], "base_failed", "kept", "entropy", "low", "high")


def passing(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of `docs` that rules() keeps, with all their columns, whatever their names.

    Rows are written with their measures to `scratch`, and what is returned reads them there. Nulls, empty texts, repeated rows and empty
    tables are treated as in rules(); rows are told by themselves, not by doc_id.
    """
    return _judged(docs, scratch or Scratch(docs.sparkSession, "quality"), F.col("row")).filter("kept").select("row.*")

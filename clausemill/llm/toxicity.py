"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs, accented letters and digit substitutions to one letter each, drops invisible characters and turns all else into
spaces. The lexicon (whole words and word beginnings) and its weights are learnt from labelled rows, as are the
exception phrases: a neighbouring word that makes a lexicon word harmless. A document's weights, by themselves and normalised by
its length, go through a logistic calibration.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out, released, spread

#: Labelled rows of each class that are learnt from at most: those with the lowest hashes of their ids.
SAMPLE = 20_000
#: A term is in the lexicon if it stands in so many toxic documents and after so many different words there, and is e ** LEAST_WEIGHT times
#: as frequent in them as in the others.
LEAST_DOCS, LEAST_CONTEXTS, LEAST_WEIGHT = 5, 4, 3.0
BEGINNINGS = range(4, 8)
EXCEPTION_DOCS, EXCEPTION_SHARE = 3, 0.8

# Look-alikes of Latin letters, and substitutions.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ß": "ss", "ø": "o", "đ": "d", "ł": "l",
}
SUBSTITUTIONS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "l", "€": "e"}
INVISIBLE = "­​‌‍⁠﻿"


class Folder(dict):
    """A str.translate table that fills itself: each character's folded form."""

    def __missing__(self, point: int) -> str:
        out = self[point] = self._fold(chr(point))
        return out

    def _fold(self, c: str) -> str:
        if c in INVISIBLE or unicodedata.category(c) == "Mn":
            return ""
        out = []
        for x in unicodedata.normalize("NFKD", c.lower()):
            x = HOMOGLYPHS.get(x, SUBSTITUTIONS.get(x, x))
            if unicodedata.category(x[0]) == "Mn":
                continue
            out.append(x.replace("i", "l") if x.isalnum() else " ")  # i and l stand for each other
        return "".join(out)


def folded(text: str, table: Folder) -> str:
    """Words between single spaces, with a space before and after."""
    return f" {' '.join(text.translate(table).split())} "


def terms_of(text: str) -> dict[str, int]:
    """The terms of a folded text, each with a bit set of what stands before it. A whole word ends with a space."""
    out: dict[str, int] = {}
    before = ""
    for word in text.split():
        bit = 1 << (hash_of(before) % 62)
        if 2 < len(word) < 40:
            for term in (f" {word} ", *(f" {word[:k]}" for k in BEGINNINGS if k <= len(word))):
                out[term] = out.get(term, 0) | bit
        before = word
    return out


def hash_of(word: str) -> int:
    h = 5381
    for c in word:
        h = (h * 33 + ord(c)) & 0xFFFFFFFF
    return h


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: set[tuple[str, str]] = field(default_factory=set)  # (word before, term) and (term, word after)
    calibration: tuple[float, ...] = (-9.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        out = ahocorasick.Automaton()
        for term in self.weights:
            out.add_word(term, term)
        out.make_automaton()
        return out


def hits(text: str, automaton: ahocorasick.Automaton | None) -> list[tuple[str, str, str]]:
    """(term, word before, word after) of each match in a folded text; the longest term of those that begin in one place."""
    if automaton is None:
        return []
    at: dict[int, str] = {}
    for end, term in automaton.iter(text):
        start = end - len(term) + 1
        if len(term) > len(at.get(start, "")):
            at[start] = term
    out = []
    for start, term in at.items():
        stop = text.index(" ", start + 1)
        out.append((term, text[text.rfind(" ", 0, start) + 1 : start], text[stop + 1 : text.find(" ", stop + 1)] if stop + 1 < len(text) else ""))
    return out


def features(found: list[tuple[str, str, str]], n_words: int, lexicon: Lexicon) -> tuple[float, float]:
    """The weight of what was found, on a log scale, and its weight per hundred words."""
    total = sum(lexicon.weights[t] for t, before, after in found if (before, t) not in lexicon.exceptions and (t, after) not in lexicon.exceptions)
    return math.log1p(total), math.log1p(100 * total / max(1, n_words))


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Coefficients of a logistic regression with a weak ridge, by Newton's method."""
    design = np.c_[np.ones(len(x)), x]
    b = np.zeros(design.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.eye(len(b)) * 0.01
        step = np.linalg.solve(hessian, design.T @ (y - p) - 0.01 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def sampled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(toxic, text) of learning rows: labelled, not held out, `most` of each class."""
    marked = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    picked = [marked.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("toxic", "text")


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Lexicon:
    """Lexicon, exceptions and calibration from at most `most` labelled rows of each class that aren't held out."""
    scratch = Scratch(docs.sparkSession, "toxic")
    rows = scratch.put(sampled(docs, labels, most), "sample")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, calibration=((9.0 if n1 else -9.0), 0.0, 0.0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = Folder(), {}

        def sent() -> pa.RecordBatch:
            values = list(held.values())
            return pa.record_batch([pa.array(list(held), pa.string()), *[pa.array([v[k] for v in values], pa.int64()) for k in range(3)]], ["term", "toxic_docs", "other_docs", "contexts"])

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term, bits in terms_of(folded(text, table)).items():
                    v = held.setdefault(term, [0, 0, 0])
                    v[0 if toxic else 1] += 1
                    if toxic:
                        v[2] |= bits
                if len(held) > 1 << 19:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    counts = rows.mapInArrow(count, "term string, toxic_docs long, other_docs long, contexts long").groupBy("term").agg(F.sum("toxic_docs").alias("a"), F.sum("other_docs").alias("b"), F.bit_count(F.expr("bit_or(contexts)")).alias("c"))
    weight = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    found = counts.filter((F.col("a") >= LEAST_DOCS) & (F.col("c") >= LEAST_CONTEXTS)).withColumn("weight", weight).filter(F.col("weight") >= LEAST_WEIGHT).select("term", "weight", "a").collect()
    lexicon = Lexicon(pruned({r["term"]: r["weight"] for r in found}, {r["term"]: r["a"] for r in found}))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, automaton = Folder(), lexicon.automaton()
        for batch in batches:
            toxic, n_words, found = [], [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plain = folded(text, table)
                toxic.append(label)
                n_words.append(plain.count(" ") - 1)
                found.append([{"t": t, "b": b, "a": a} for t, b, a in hits(plain, automaton)])
            kind = pa.list_(pa.struct([("t", pa.string()), ("b", pa.string()), ("a", pa.string())]))
            yield pa.record_batch([pa.array(toxic, pa.int32()), pa.array(n_words, pa.int64()), pa.array(found, kind)], ["toxic", "n_words", "found"])

    described = scratch.put(rows.mapInArrow(describe, "toxic int, n_words long, found array<struct<t:string,b:string,a:string>>"), "described")
    phrases = described.select("toxic", F.explode("found").alias("f")).select("toxic", F.explode(F.array(F.struct(F.col("f.b").alias("x"), F.col("f.t").alias("y")), F.struct(F.col("f.t").alias("x"), F.col("f.a").alias("y")))).alias("p"))
    shares = phrases.groupBy("p.x", "p.y").agg(F.sum(1 - F.col("toxic")).alias("b"), F.count(F.lit(1)).alias("n")).filter((F.col("b") >= EXCEPTION_DOCS) & (F.col("b") >= EXCEPTION_SHARE * F.col("n")))
    lexicon.exceptions = {(r["x"], r["y"]) for r in shares.collect()}
    x, y = [], []
    for r in described.select("toxic", "n_words", "found").toLocalIterator():
        x.append(features([(f["t"], f["b"], f["a"]) for f in r["found"]], r["n_words"], lexicon))
        y.append(r["toxic"])
    lexicon.calibration = calibrated(np.array(x), np.array(y, float))
    scratch.close()
    return lexicon


def pruned(weights: dict[str, float], docs: dict[str, int]) -> dict[str, float]:
    """Without beginnings that owe nine tenths of their documents to one longer beginning, and then without terms that
    a kept, shorter beginning covers with about the same weight."""
    special = {t for t in weights if not t.endswith(" ") and any(docs[u] >= 0.9 * docs[t] for u in weights if len(u) > len(t) and u.startswith(t) and not u.endswith(" "))}
    kept: dict[str, float] = {}
    for term in sorted(weights.keys() - special, key=lambda t: (len(t), t)):
        if not any(weights[term] < kept[term[:k]] + 1 for k in range(2, len(term)) if term[:k] in kept):
            kept[term] = weights[term]
    return kept


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted, found (terms) for each row of `docs` (doc_id, text).

    Null or empty text: the score of a text without any term. Null ids aren't held out. Repeated rows each count. No rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.calibration))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = Lexicon(*shared.value), Folder()
        automaton, b = own.automaton(), own.calibration
        for batch in batches:
            scores, found = [], []
            for text in batch.column(1).to_pylist():
                plain = folded(text or "", table)
                met = hits(plain, automaton)
                x = features(met, plain.count(" ") - 1, own)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, b[0] + b[1] * x[0] + b[2] * x[1])))))
                found.append(sorted({t.strip() for t, _, _ in met}))
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.string()))], ["doc_id", "score", "found"])
        released()

    out = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, score double, found array<string>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "found")

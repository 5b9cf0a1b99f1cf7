"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A benchmark item's windows (WINDOW consecutive words, or the whole item if it has fewer) are the patterns. A window's alphabet
is words; a block is its last two words. For every block in a pattern, the shift table holds how far the
search may move on from a position that ends with it; a block of no pattern moves the search by a window less one word.
Blocks that end a pattern have shift 0 and lead, by hash of the suffix, to the patterns that end so, which are compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, released, wrapped
from .kneser_ney import raw

WINDOW, BLOCK = 10, 2
#: Words of benchmark text whose tables a worker holds at a time, at some 600 bytes each (hashed parts hold half of that on the average); a larger benchmark
#: takes several passes over the documents, one after the other. A longer item is cut into pieces of PIECE windows.
PASS_WORDS, PIECE = 200_000, 4096
#: Words, as words_of() takes them.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: A-Z to a-z, other ASCII but digits and a-z to space; bytes from 0x80 on belong to words.
_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


class WuManber:
    """Search for patterns of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[int]]] = {}

    def add(self, pattern: tuple[bytes, ...], item: int) -> None:
        b, m = self.block, self.length
        for end in range(b, m + 1):
            key = pattern[end - b : end]
            if m - end < self.shift.get(key, m):
                self.shift[key] = m - end
        items = self.buckets.setdefault(pattern[m - b :], {}).setdefault(pattern, [])
        if not items or items[-1] != item:
            items.append(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(position of the first word, items) of each occurrence."""
        m, b, shift, far = self.length, self.block, self.shift, self.length - self.block + 1
        end, n = m, len(words)
        while end <= n:
            block = tuple(words[end - b : end])
            step = shift.get(block, far)
            if step == 0:
                candidates = self.buckets.get(block)
                if candidates:
                    items = candidates.get(tuple(words[end - m : end]))
                    if items:
                        yield end - m, items
                step = 1
            end += step


def searchers(items: list[tuple[int, bytes]]) -> list[WuManber]:
    """One table per window length."""
    by_length: dict[int, WuManber] = {}
    for item, text in items:
        words = words_of(text)
        m = min(WINDOW, len(words))
        if m:
            search = by_length.setdefault(m, WuManber(m))
            for k in range(len(words) - m + 1):
                search.add(tuple(words[k : k + m]), item)
    return list(by_length.values())


def found_in(text: bytes | None, tables: list[WuManber]) -> tuple[int, list[tuple[int, int]], list[int]]:
    """Number of words, merged spans of hit words (from, to), sorted distinct items."""
    words = words_of(text)
    spans: list[tuple[int, int]] = []
    items: set[int] = set()
    for table in tables:
        for at, hit in table.search(words):
            spans.append((at, at + table.length))
            items.update(hit)
    return len(words), merged(spans), sorted(items)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def pieces(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, n): the words of each item, with a space between, in pieces that share WINDOW - 1 words, so that each window stands in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, sizes = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(raw(text))
                for k in range(0, max(1, len(words) - WINDOW + 1) if words else 0, PIECE):
                    own = words[k : k + PIECE + WINDOW - 1]
                    ids.append(item)
                    texts.append(b" ".join(own))
                    sizes.append(len(own))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64())], ["item_id", "words", "n"])

    usable = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return usable.mapInArrow(run, "item_id long, words binary, n long").distinct()


#: What search() finds.
FOUND = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_KIND = pa.struct([("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.int64()))])


def finder(scratch: Scratch, items: list[tuple[int, bytes]]):
    """A column function of text: FOUND."""
    shared = scratch.share(items)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = searchers(shared.value)
        for texts in batches:
            n_words, spans, found = [], [], []
            for text in texts:
                n, s, i = found_in(raw(text), tables)
                n_words.append(n)
                spans.append([{"start": a, "end": b} for a, b in s])
                found.append(i)
            yield pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(found, pa.list_(pa.int64()))], fields=list(_KIND))
        released()

    return F.arrow_udf(run, FOUND, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()  # lest a filter evaluates it again


def search(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(row, found): each row of `docs` (with text) as a struct; its number of words, spans (word ranges inside occurrences) and items.

    Words are runs of ASCII letters and digits and all characters beyond ASCII, A-Z lower-cased. Null or empty text: no words, no
    hits. Items without an id or words have no windows; equal items each count. No benchmark rows: no hits. Repeated and
    extra rows and columns of `docs` pass through as they are. A benchmark of one pass, as most, is searched for as the result is read;
    otherwise each pass is written, and the driver and the workers hold one part of the benchmark at a time.
    """
    scratch = scratch or Scratch(docs.sparkSession, "leaks")
    parts = pieces(benchmark)
    total = benchmark.filter("item_id is not null").agg(F.coalesce(F.sum(F.regexp_count(F.col("text"), F.lit(WORDS))), F.lit(0)).alias("n")).first()["n"]
    passes = -(-2 * total // PASS_WORDS) if total > PASS_WORDS else 1
    rows = wrapped(docs)
    for k in range(passes):
        part = parts if passes == 1 else parts.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(passes)) == k)
        own = finder(scratch, sorted((r["item_id"], bytes(r["words"])) for r in part.collect()))(F.col("row.text").cast("string"))
        if not k:
            rows = rows.withColumn("found", own)
        else:
            both = F.struct(F.col("found.n_words"), F.concat("found.spans", "more.spans").alias("spans"), F.array_sort(F.array_union("found.items", "more.items")).alias("items"))
            rows = rows.withColumn("more", own).withColumn("found", both).drop("more")
        if passes > 1:
            rows = scratch.put(rows, f"pass-{k}")
            scratch.unshare()
            scratch.drop_all_but(f"pass-{k}")
    return rows


def covered(spans: Column) -> Column:
    """Number of words in the union of the spans."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    return F.aggregate(F.array_sort(spans), state, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["to"]))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")), lambda s: s["n"])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row; odd rows as in search()."""
    found = search(docs.select("doc_id", "text"), benchmark)
    names = F.array_join(F.array_sort(F.transform("found.items", lambda i: i.cast("string"))), ",")
    n = F.size("found.items")
    return found.select("row.doc_id", "found.n_words", covered(F.col("found.spans")).alias("n_hit"), n.cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of `docs` without a hit word, with all their columns, whatever their names; odd rows as in search()."""
    return search(docs, benchmark, scratch).filter(F.size("found.items") == 0).select("row.*")

"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged numpy arrays.

Texts are cut into pre-tokens; the distinct new ones of a batch lie one after another in one symbol array. In each turn every
sequence looks up the ranks of its adjacent pairs, and its lowest-ranked pair is merged at all its places at once. A sequence without a
mergeable pair is finished, and the symbols that survive are its tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, spread

#: The vocabulary's split pattern (fixed value of its format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters cut into pre-tokens at a time, and pre-token counts kept by a task.
PIECE, KNOWN = 1 << 20, 1 << 18
NONE = np.int32(2**31 - 1)


@dataclass
class Vocabulary:
    byte_ids: np.ndarray  # id of each single byte
    pairs: np.ndarray  # sorted left * 2^32 + right
    ranks: np.ndarray  # of pairs
    merged: np.ndarray  # id that a pair becomes, by rank
    specials: list[str]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a tokenizer file of the byte-level BPE kind."""
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        ids = data["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        # printable Latin-1 characters stand for their own bytes, the other bytes for the characters from U+0100 on
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        byte_ids = np.array([ids[chr(b if b in own else next(others))] for b in range(256)], np.int32)
        keys = np.array([(ids[a] << 32) + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        merged = np.array([ids[a + b] for a, b in merges], np.int32)
        return cls(byte_ids, keys[order], order.astype(np.int32), merged, [t["content"] for t in data.get("added_tokens", [])])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.ranks[at], NONE)


def alternate(hit: np.ndarray) -> np.ndarray:
    """Of adjacent hits, as a run of equal symbols gives, every other one from the left."""
    if not (hit[1:] & hit[:-1]).any():
        return hit
    at = np.flatnonzero(hit)
    first = np.r_[True, np.diff(at) > 1]
    run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    out = np.zeros_like(hit)
    out[at[(np.arange(len(at)) - run) % 2 == 0]] = True
    return out


def merged_sizes(vocabulary: Vocabulary, sequences: list[bytes]) -> np.ndarray:
    """Number of tokens of each byte sequence (none empty)."""
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    out = sizes.copy()
    symbols = vocabulary.byte_ids[np.frombuffer(b"".join(sequences), np.uint8)]
    owner = np.repeat(np.arange(len(sequences)), sizes)
    while len(symbols) > 1:
        rank = np.append(np.where(owner[1:] == owner[:-1], vocabulary.rank(symbols[:-1], symbols[1:]), NONE), NONE)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.r_[starts, len(symbols)])
        out[owner[starts]] = lengths
        least = np.repeat(lowest, lengths)
        hit = alternate((rank == least) & (least != NONE))
        if not hit.any():
            break
        symbols = np.where(hit, vocabulary.merged[np.where(hit, rank, 0)], symbols)
        keep = ~np.r_[False, hit[:-1]] & (least != NONE)
        symbols, owner = symbols[keep], owner[keep]
    else:
        out[owner] = len(symbols)
    return out


class TokenCounter:
    """Counts tokens of texts; pre-tokens that were met before are looked up."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.specials))) if vocabulary.specials else None
        self.seam = regex.compile(r"(?<=\p{L})(?= \p{L})")

    def pieces(self, text: str) -> Iterator[str]:
        """Parts of about PIECE characters, cut where a space between letters begins a pre-token anyway."""
        start = 0
        while len(text) - start > PIECE:
            seam = self.seam.search(text, start + PIECE)
            if not seam:
                break
            yield text[start : seam.start()]
            start = seam.start()
        yield text[start:]

    def _count(self, lists: list[list[str]]) -> list[int]:
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        fresh = list(set().union(*lists).difference(known))
        if fresh:
            known.update(zip(fresh, merged_sizes(self.vocabulary, [t.encode() for t in fresh]).tolist(), strict=True))
        return [sum(map(known.__getitem__, x)) for x in lists]

    def __call__(self, texts: Iterable[str | None]) -> list[int]:
        totals, lists, owners, held = [], [], [], 0
        for text in texts:
            totals.append(0)
            if not text:
                continue
            parts = [text]
            if self.special is not None and self.special.search(text):
                totals[-1] += len(self.special.findall(text))
                parts = self.special.split(text)
            for part in parts:
                for piece in self.pieces(part):
                    lists.append(self.split(piece))
                    owners.append(len(totals) - 1)
                    held += len(piece)
                    if held >= PIECE:
                        for k, n in zip(owners, self._count(lists), strict=True):
                            totals[k] += n
                        lists, owners, held = [], [], 0
        for k, n in zip(owners, self._count(lists), strict=True):
            totals[k] += n
        return totals


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of `docs` (doc_id, text), with the tokenizer file at `path` on the driver.

    Special strings of the vocabulary count as one token where they occur. Null or empty text: 0 bytes and tokens. Null ids,
    repeated rows and other columns don't matter. No rows: no rows. The vocabulary (fixed size) is broadcast.
    """
    v = Vocabulary.load(path)
    shared = docs.sparkSession.sparkContext.broadcast((v.byte_ids, v.pairs, v.ranks, v.merged, v.specials))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter(Vocabulary(*shared.value))
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            yield pa.record_batch([batch.column(0), n_bytes, pa.array(count(texts.to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        released()

    counted = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

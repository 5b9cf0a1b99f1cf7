"""Modified Kneser-Ney character models of running text, counted and estimated by Spark, held in sorted hash arrays.

An n-gram is ORDER code points of a text's words with one space between them, so it runs on across words. Nothing is folded or hashed
into classes: the number of n-grams grows with the corpus. Counts, discounts and interpolated probabilities are DataFrame aggregates,
windows and joins. For scoring, n-grams become 64-bit hashes in sorted arrays; a pass over the texts holds SHARD_GRAMS of them at most
(dealt by the character before the last, which an n-gram shares with all lower orders it falls back on), and a larger model
takes several passes, whose sums add up to the same score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, released

ORDER = 5
#: N-grams that one pass of scoring broadcasts: 24 bytes each in a worker, so 96 MB.
SHARD_GRAMS = 4_000_000
#: Below all orders, every character is as likely.
CODE_POINTS = 0x110000
#: Orders up to this are estimated in one job.
TOGETHER = 3
#: N-grams that the driver turns into arrays at a time.
LOADED = 1 << 16
#: N-grams that a counting task holds before it sends them on.
COUNTED = 1 << 19
#: Bytes of scores that a scoring task keeps by hash.
KEPT_BYTES = 1 << 25

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def stream(text: bytes | None, lower: bool) -> str:
    """The words of a text, with a space after each; empty if there are none. (bytes.split cuts at space and U+0009 to U+000D.)"""
    words = text.split() if text else []
    if not words:
        return ""
    out = (b" ".join(words) + b" ").decode("utf-8", "replace").replace("\0", "�")
    return out.lower() if lower else out


def points_of(streams: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points with ORDER - 1 spaces before each stream, number of points of each)."""
    pad = " " * (ORDER - 1)
    points = np.frombuffer("".join(pad + s for s in streams).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.fromiter(map(len, streams), np.int64, len(streams)) + ORDER - 1


def hash_of(points: np.ndarray, order: int) -> np.ndarray:
    """Hash of the `order` points up to each; the first places hold no meaning."""
    wide, out = points.astype(np.uint64), np.zeros(len(points), np.uint64)
    for k in range(order):
        out[k:] += (wide[: len(points) - k] + np.uint64(k + 1)) * _ODD[k]
    return out


def pads(sizes: np.ndarray) -> np.ndarray:
    """Places of the spaces before each stream, which aren't predicted."""
    return ((np.cumsum(sizes) - sizes)[:, None] + np.arange(ORDER - 1)).ravel()


def in_parts(texts: pa.Array, limit: int = 1 << 20) -> Iterator[list[bytes | None]]:
    """A column of texts in runs of about `limit` bytes."""
    part, held = [], 0
    for text in texts:
        part.append(raw(text))
        held += len(part[-1] or b"")
        if held >= limit:
            yield part
            part, held = [], 0
    if part:
        yield part


def raw(text: pa.Scalar) -> bytes | None:
    """A string's bytes, without decoding it."""
    return text.as_buffer().to_pybytes() if text.is_valid else None


class Tally:
    """Distinct n-grams of streams and how often each occurs, by key."""

    def __init__(self):
        self.held: dict[tuple, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, key: tuple, streams: list[str]) -> None:
        points, sizes = points_of(streams)
        if not len(points):
            return
        keys = hash_of(points, ORDER)
        keys[pads(sizes)] = 0
        grams, ends, n = np.unique(keys, return_index=True, return_counts=True)
        grams, ends, n = grams[grams != 0], ends[grams != 0], n[grams != 0]
        own = np.stack([points[ends - k] for k in range(ORDER - 1, -1, -1)], axis=1)
        parts = self.held.setdefault(key, [])
        parts.append((grams, own, n))
        self.size += len(grams)
        if len(parts) > 1 and len(grams) + sum(len(p[0]) for p in parts[1:-1]) > len(parts[0][0]) // 2:
            self._merge(key)

    def _merge(self, key: tuple) -> None:
        parts = self.held[key]
        grams = np.concatenate([p[0] for p in parts])
        met, first, inverse = np.unique(grams, return_index=True, return_inverse=True)
        n = np.bincount(inverse, np.concatenate([p[2] for p in parts])).astype(np.int64)
        self.size -= len(grams) - len(met)
        self.held[key] = [(met, np.concatenate([p[1] for p in parts])[first], n)]

    def batches(self) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        """(key, n-grams as strings, counts); forgets them."""
        for key in list(self.held):
            self._merge(key)
            _, points, n = self.held.pop(key)[0]
            for k in range(0, len(n), 1 << 16):
                yield key, np.ascontiguousarray(points[k : k + (1 << 16)]).view(f"<U{ORDER}").ravel(), n[k : k + (1 << 16)]
        self.size = 0


def counted(texts: DataFrame, lower: bool) -> DataFrame:
    """(grp, gram, n) over all rows of (grp string, text string); a null grp counts for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def sent() -> Iterator[pa.RecordBatch]:
            for (group,), grams, n in tally.batches():
                yield pa.record_batch([pa.array([group] * len(n), pa.string()), pa.array(grams.tolist(), pa.string()), pa.array(n, pa.int64())], ["grp", "gram", "n"])

        for batch in batches:
            groups, at = batch.column(0).to_pylist(), 0
            for part in in_parts(batch.column(1)):
                streams: dict[str, list[str]] = {}
                for group, text in zip(groups[at : at + len(part)], part, strict=True):
                    if group is not None and text:
                        streams.setdefault(group, []).append(stream(text, lower))
                at += len(part)
                for group, own in streams.items():
                    tally.add((group,), own)
                if tally.size > COUNTED:
                    yield from sent()
        yield from sent()
        released()

    return texts.select("grp", F.col("text").cast("string")).mapInArrow(run, "grp string, gram string, n long").groupBy("grp", "gram").agg(F.sum("n").alias("n"))


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the numbers of counts 1 to 4; 0.5 where these give none."""
    out = [0.5, 0.5, 0.5]
    if all(n):
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k] / n[k - 1]
            if 0 < d < k:
                out[k - 1] = d
    return out


@dataclass
class Model:
    """Rows (grp, k, gram, logp, logw): the interpolated log-probability of the last character of each k-gram after the others, and the log-weight that those leave to the next lower order."""

    rows: DataFrame
    groups: list[str]  # in code point order
    grams: int

    @property
    def shards(self) -> int:
        return max(1, -(-self.grams // SHARD_GRAMS))

    def shard(self, k: int) -> tuple:
        """One shard's arrays, as plain values for a broadcast."""
        rows = self.rows
        if self.shards > 1:
            before = F.ascii(F.substring("gram", F.col("k") - 1, F.lit(1)))
            rows = rows.filter((F.col("k") == 1) | (F.pmod(before, F.lit(self.shards)) == k))
        number = {g: j for j, g in enumerate(self.groups)}
        levels = []
        for n in range(1, ORDER + 1):  # order by order and batch by batch, so that the driver holds one order as it comes and one batch's points
            table = rows.filter(F.col("k") == n).select("grp", "gram", "logp", "logw").toArrow()
            keys, contexts = np.empty(table.num_rows, np.uint64), np.empty(table.num_rows, np.uint64)
            logp, logw, end = np.empty(table.num_rows, np.float32), np.empty(table.num_rows, np.float32), 0
            for batch in table.to_batches(max_chunksize=LOADED):
                own = slice(end, end := end + batch.num_rows)
                names = batch.column(0).dictionary_encode()
                shift = group_hash(np.array([number[g] for g in names.dictionary.to_pylist()], np.uint64)[names.indices.to_numpy()])
                points = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, n)
                keys[own], contexts[own] = gram_hashes(points) + shift, gram_hashes(points[:, :-1]) + shift
                logp[own], logw[own] = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            table = batch = names = points = shift = None
            at = np.argsort(keys)
            keys, logp = keys[at], logp[at]
            del at
            contexts, first = np.unique(contexts, return_index=True)
            levels.append((keys, logp, contexts, logw[first]))
            del first, logw
            released()
        return (k, self.shards, len(self.groups), float(-np.log(CODE_POINTS)), levels)


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """The hashes of hash_of() for rows of points."""
    out = np.zeros(len(points), np.uint64)
    for k in range(points.shape[1]):
        out += (points[:, points.shape[1] - 1 - k].astype(np.uint64) + np.uint64(k + 1)) * _ODD[k]
    return out


def group_hash(number: np.ndarray) -> np.ndarray:
    return (number + np.uint64(1)) * _ODD[ORDER]


def estimated(counts: DataFrame, scratch: Scratch, label: str) -> Model:
    """The model of (grp, gram, n), n-grams of ORDER characters.

    Counts of lower orders are the number of distinct characters before an n-gram (continuation counts). Windows run over the n-grams of one
    context, of which there are no more than characters.
    """
    level, all_levels = counts, counts.select("grp", F.lit(ORDER).alias("k"), "gram", "n")
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy("grp", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        all_levels = all_levels.unionByName(level.select("grp", F.lit(k).alias("k"), "gram", "n"))
    levels = scratch.put(all_levels, f"{label}-levels")
    seen = levels.groupBy("grp", "k").agg(*[F.count_if(F.col("n") == j).alias(f"n{j}") for j in range(1, 5)], F.count(F.lit(1)).alias("size")).collect()
    groups, size = sorted({r["grp"] for r in seen}), sum(r["size"] for r in seen)
    spark = counts.sparkSession
    cuts = spark.createDataFrame([(r["grp"], r["k"], *discounts([r[f"n{j}"] for j in range(1, 5)])) for r in seen], "grp string, k int, d1 double, d2 double, d3 double")
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    lower, found, done = None, [], 0
    for k in range(1, ORDER + 1):
        own = levels.filter(F.col("k") == k).join(F.broadcast(cuts.filter(F.col("k") == k).drop("k")), "grp").withColumn("cut", cut)
        context = Window.partitionBy("grp", F.substring("gram", 1, k - 1)) if k > 1 else Window.partitionBy("grp")
        shares = own.withColumn("total", F.sum("n").over(context)).withColumn("weight", F.sum("cut").over(context) / F.col("total"))
        if lower is None:
            shares = shares.withColumn("less", F.lit(1.0 / CODE_POINTS))
        else:
            shares = shares.join(lower.select("grp", F.col("gram").alias("rest"), F.col("p").alias("less")), (shares["grp"] == lower["grp"]) & (F.substring("gram", 2, k - 1) == F.col("rest"))).drop(lower["grp"])
        p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("weight") * F.col("less")
        lower = shares.select("grp", "k", "gram", p.alias("p"), "weight")
        found.append(lower)
        if k >= TOGETHER:  # the lower orders are small, and are estimated in one job
            written = scratch.put(reduce(DataFrame.unionByName, found[done:]), f"{label}-order-{k}")
            found[done:] = [written]
            done, lower = len(found), written.filter(F.col("k") == k)
    rows = reduce(DataFrame.unionByName, found).select("grp", "k", "gram", F.log("p").cast("float").alias("logp"), F.log("weight").cast("float").alias("logw"))
    return Model(rows, groups, size)


class Scorer:
    """Sums of log-probabilities of streams under a shard of a model, rebuilt on a worker from the shard's plain arrays.

    Scores of n-grams are kept by hash in tables of KEPT_BYTES, where a newer one takes an older one's slot.
    """

    def __init__(self, shard: tuple, every: bool):
        """every: score under all groups; otherwise, each stream under one."""
        self.part, self.parts, self.n_groups, self.floor, self.levels = shard
        self.columns = self.n_groups if every else 1
        self.bits = max(10, (KEPT_BYTES // (8 + 4 * max(1, self.columns))).bit_length() - 1)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros((1 << self.bits, self.columns), np.float32)

    def log_probability(self, points: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Of n-grams given as rows of ORDER points, under a group each."""
        out, rest, shift = np.zeros(len(group), np.float32), np.arange(len(group)), group_hash(group)
        for k in range(ORDER, 0, -1):
            grams, logp, contexts, logw = self.levels[k - 1]
            if not len(grams):
                continue
            key = gram_hashes(points[rest, ORDER - k :]) + shift[rest]
            at = np.minimum(np.searchsorted(grams, key), len(grams) - 1)
            hit = grams[at] == key
            out[rest[hit]] += logp[at[hit]]
            rest = rest[~hit]
            if not len(rest):
                return out
            key = gram_hashes(points[rest, ORDER - k : -1]) + shift[rest]
            at = np.minimum(np.searchsorted(contexts, key), len(contexts) - 1)
            out[rest] += np.where(contexts[at] == key, logw[at], np.float32(0))
        out[rest] += np.float32(self.floor)
        return out

    def totals(self, streams: list[str], group: np.ndarray | None = None) -> np.ndarray:
        """(streams, columns): summed log-probabilities of each stream's characters of this shard."""
        points, sizes = points_of(streams)
        if not len(points) or not self.n_groups:
            return np.zeros((len(streams), self.columns))
        key = hash_of(points, ORDER)
        if group is not None:
            key += np.repeat(group_hash(group.astype(np.uint64)), sizes)
        key |= np.uint64(1)  # 0 marks an empty slot
        slot = (key * _ODD[1]) >> np.uint64(64 - self.bits)
        values = self.values[slot]
        missed = np.flatnonzero(self.keys[slot] != key)
        missed = missed[missed >= ORDER - 1]
        if len(missed):
            _, first, inverse = np.unique(key[missed], return_index=True, return_inverse=True)
            one = missed[first]
            own = np.stack([points[one - k] for k in range(ORDER - 1, -1, -1)], axis=1)
            if group is not None:
                fresh = self.log_probability(own, np.repeat(group.astype(np.uint64), sizes)[one])[:, None]
            else:
                fresh = np.stack([self.log_probability(own, np.full(len(one), j, np.uint64)) for j in range(self.n_groups)], axis=1)
            self.keys[slot[one]], self.values[slot[one]] = key[one], fresh
            values[missed] = fresh[inverse]
        values[pads(sizes)] = 0
        if self.parts > 1:
            values[1:][points[:-1] % self.parts != self.part] = 0
        starts = np.cumsum(sizes) - sizes
        return np.stack([np.add.reduceat(values[:, j], starts, dtype=np.float64) for j in range(self.columns)], axis=1)

"""Exact nearest vectors of a block of questions as matrix products in the workers.

A product in single precision only tells which pairs can't be among the best; its error is bounded, so what is left holds every one that is. Those pairs
are scored in double precision in the order of the coordinates, as a sum over the arrays would be. Functions travel by value, so workers need no copy of the package.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Coordinates of a block's questions (8 MB in a worker); questions and vectors of one product.
MATRIX, ROWS, COLUMNS = 1 << 20, 256, 4096
#: Candidates that a worker holds, at least; what must be kept beyond it leaves the worker.
HELD = 1 << 20
#: Scores are rounded to nine digits later, which makes ties of those that differ by less.
TIE = 2e-9


def by_size(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, matrix, incomplete) of the lists of each length; null lists are left out, and a list with a null in it is incomplete."""
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths >= 0]):
        places = np.flatnonzero(lengths == d)
        flat = lists.take(pa.array(places)).flatten()
        values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(len(places), d)
        incomplete = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(places), d).any(axis=1) if d else np.ones(len(places), bool)
        yield places, values, incomplete


class Side:
    """Vectors of one length: coordinates by rows, norms, unit vectors in single precision and which of them are plain (a finite norm above 0, nothing null)."""

    def __init__(self, places: np.ndarray, values: np.ndarray, incomplete: np.ndarray):
        self.places, self.incomplete, self.by_coordinate = places, incomplete, np.ascontiguousarray(values.T)
        with np.errstate(all="ignore"):
            total = np.zeros(len(places))
            for x in self.by_coordinate:
                total += x * x
            self.norms = np.sqrt(total)
            # sums that underflow have lost digits
            plain = ~incomplete & np.isfinite(self.norms) & (self.norms > 1e-140)
            self.plain, self.odd = np.flatnonzero(plain), np.flatnonzero(~plain)
            self.units = (values[self.plain] / self.norms[self.plain, None]).astype(np.float32)


def keys(a: Side, i: np.ndarray, b: Side, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs; infinite where it isn't a number, as that ranks first, minus infinite where a coordinate is null."""
    with np.errstate(all="ignore"):
        total = np.zeros(len(i))
        for x, y in zip(a.by_coordinate, b.by_coordinate):
            total += x[i] * y[j]
        score = total / (a.norms[i] * b.norms[j])
    score[np.isnan(score)] = np.inf
    score[a.incomplete[i] | b.incomplete[j]] = -np.inf
    return score


class Best:
    """Candidates of a task: all that may be among the k best of their question."""

    def __init__(self, questions: int, k: int):
        self.k, self.limit = k, max(HELD, 2 * questions * k)
        self.floor = np.full(questions, -np.inf)  # a lower bound of the k-th best score
        self.kept: tuple | None = None  # question, key, then ids as Arrow arrays
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # question, key, row of the batch
        self.count = 0

    def add(self, q: np.ndarray, key: np.ndarray, row: np.ndarray) -> None:
        self.fresh.append((q, key, row))
        self.count += len(q)

    def settle(self, ids: list[pa.Array]) -> None:
        """Takes the ids of what came from this batch and drops what k others of its question surely precede."""
        if not self.fresh:
            return
        q, key, row = (np.concatenate(x) for x in zip(*self.fresh))
        self.fresh, taken = [], [x.take(pa.array(row)) for x in ids]
        if self.kept is not None:
            q, key, taken = np.concatenate([self.kept[0], q]), np.concatenate([self.kept[1], key]), [pa.concat_arrays(x) for x in zip(self.kept[2], taken)]
        order = np.lexsort((-key, q))
        if self._run(q[order], key[order]).max(initial=0) >= self.k:  # many equal scores: the smaller ids are enough
            order = np.lexsort((pc.rank(taken[0], tiebreaker="dense").to_numpy(), -key, q))
        q, key = q[order], key[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        full = np.diff(np.r_[first, len(q)]) >= self.k
        asked = q[first[full]]
        self.floor[asked] = np.maximum(self.floor[asked], key[first[full] + self.k - 1])
        with np.errstate(invalid="ignore"):
            stays = (key >= self.floor[q] - TIE) & (self._run(q, key) < self.k)
        self.kept = q[stays], key[stays], [x.take(pa.array(order[stays])) for x in taken]
        self.count = int(stays.sum())

    @staticmethod
    def _run(q: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Number of rows before each with the same question and score, in sorted rows."""
        n = np.arange(len(q))
        begins = np.r_[True, (q[1:] != q[:-1]) | (key[1:] != key[:-1])] if len(q) else np.zeros(0, bool)
        return n - np.maximum.accumulate(np.where(begins, n, 0)) if len(q) else n

    def flush(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.kept is None:
            return
        q, key, ids = self.kept
        score = pa.array(np.where(np.isposinf(key), np.nan, key), mask=np.isneginf(key))
        columns = [pa.array(q.astype(np.int32)), *ids, score]
        self.kept, self.count = None, 0
        for at in range(0, len(q), 1 << 16):
            yield pa.RecordBatch.from_arrays([c.slice(at, 1 << 16) for c in columns], names=schema)


def finder(shared: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (clause_id, standard_id, dense) to (qn, clause_id, standard_id, score), a superset of each question's k best; `shared` holds the questions' vectors."""

    def pairs(asked: Side, some: np.ndarray, others: Side, which: np.ndarray, best: Best, approximate: bool) -> None:
        margin = 2 * (len(asked.by_coordinate) + 8) * 2.0**-24 + TIE if approximate else TIE
        for v in range(0, len(which), COLUMNS):
            j = which[v : v + COLUMNS]
            for u in range(0, len(some), ROWS):
                i = some[u : u + ROWS]
                at = asked.places[i]
                if approximate:
                    met = asked.units[u : u + ROWS] @ others.units[v : v + COLUMNS].T
                else:
                    met = keys(asked, np.repeat(i, len(j)), others, np.tile(j, len(i))).reshape(len(i), len(j))
                floor = best.floor[at]
                if len(j) >= k and np.isneginf(floor).any():
                    floor = np.maximum(floor, np.partition(met, len(j) - k, axis=1)[:, len(j) - k])
                least = floor - margin
                hit = np.flatnonzero(met >= (np.nextafter(least.astype(np.float32), np.float32(-np.inf)) if approximate else least)[:, None])
                x, y = hit // len(j), hit % len(j)
                best.add(at[x], keys(asked, i[x], others, j[y]) if approximate else met[x, y], others.places[j[y]])
                if best.count > best.limit:
                    yield

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value
        by_length = {len(s.by_coordinate): s for s in (Side(*part) for part in by_size(vectors))}
        best = Best(len(vectors), k)
        names = ["qn", "clause_id", "standard_id", "score"]
        for batch in batches:
            ids = [batch.column(0), batch.column(1)]
            for part in by_size(batch.column(2)):
                others, asked = Side(*part), by_length.get(part[1].shape[1])
                if asked is None:
                    continue
                everything = np.arange(len(others.places))
                for work in (
                    pairs(asked, asked.plain, others, others.plain, best, True),
                    pairs(asked, asked.plain, others, others.odd, best, False),
                    pairs(asked, asked.odd, others, everything, best, False),
                ):
                    for _ in work:
                        best.settle(ids)
                        if best.count > best.limit // 2:
                            yield from best.flush(names)
            best.settle(ids)
        yield from best.flush(names)

    return find

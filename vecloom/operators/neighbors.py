"""Exact nearest neighbours of one set of vectors in another.

Tables have the columns ``id`` and ``x`` (array<double>).  A task holds a block
of queries and their best ``k`` while the index passes by in blocks
(:mod:`vecloom.operators.blocks`), so only ``k`` rows a query leave it, whatever
the rows of the index; a window over these gives the ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.vectors import unit
from vecloom.operators.blocks import BLOCK, BROADCAST_NUMBERS, Blocks, meet, pieces, same, source

_OUT = "i long, j long, score double"
#: Of a product in single precision: the rounding of a number, and lengths up to which it is used.
SINGLE, LONGEST = 2.0**-23, 1e15


def _exact(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Scores of the pairs q[r], x[c] to ten decimals: inner products, or negative squared distances."""
    out = np.empty(len(r))
    for at in range(0, len(r), 100_000):
        a, b = q[r[at : at + 100_000]], x[c[at : at + 100_000]]
        s = np.einsum("rd,rd->r", a, b)
        if metric == "l2":
            s = 0.0 - np.maximum(np.einsum("rd,rd->r", a, a) - 2 * s + np.einsum("rd,rd->r", b, b), 0)
        out[at : at + 100_000] = s
    return np.round(out, 10) + 0.0


class Bests:
    """The best k of some rows so far, as scored pairs pass by; equal scores go to the smaller id."""

    def __init__(self, rows: int, k: int):
        self.k, self.score, self.ids = k, np.full((rows, k), -np.inf), np.full((rows, k), np.iinfo(np.int64).max)

    def bar(self, at: slice) -> np.ndarray:
        """The k-th best of the rows ``at``, which others must reach."""
        return self.score[at, self.k - 1]

    def lowest(self, at: slice, s: np.ndarray) -> np.ndarray:
        """The bar, or the k-th best of the scores ``s`` if that is higher."""
        m = s.shape[1] - self.k
        return self.bar(at) if m <= 0 else np.maximum(self.bar(at), np.partition(s, m, axis=1)[:, m])

    def add(self, at: slice, r: np.ndarray, j: np.ndarray, s: np.ndarray) -> None:
        """Pairs of the rows ``at``: places r among them, ids and scores."""
        touched = np.unique(r)
        score, ids = self.score[at][touched], self.ids[at][touched]
        held = score > -np.inf
        r = np.concatenate([np.repeat(touched, self.k).reshape(-1, self.k)[held], r])
        s, j = np.concatenate([score[held], s]), np.concatenate([ids[held], j])
        order = np.lexsort((j, -s, r))
        order = order[np.isfinite(s[order])]
        r, s, j = r[order], s[order], j[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        kept = place < self.k
        self.score[at.start + r[kept], place[kept]] = s[kept]
        self.ids[at.start + r[kept], place[kept]] = j[kept]

    def batch(self, ids: np.ndarray, value: str = "score") -> pa.RecordBatch:
        on = self.score > -np.inf
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, self.k).reshape(-1, self.k)[on].astype(np.int64)), pa.array(self.ids[on]), pa.array(self.score[on])], names=["i", "j", value])


def best(qi: np.ndarray, q: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]], k: int, metric: str, skip_self: bool) -> pa.RecordBatch:
    """The k nearest of all blocks for each row of q; ties (to 1e-10) go to the smaller id.

    The k-th best so far is a bar for all later blocks.  Whether a pair may pass
    it is first seen from a product in single precision, with room for its
    error; the few pairs that may are scored again in double precision.
    """
    held = Bests(len(q), k)
    size_q = np.sqrt(np.einsum("rd,rd->r", q, q))
    q32 = q.astype(np.float32)
    for xi, x in blocks:
        if not len(xi):
            continue
        size_x = np.sqrt(np.einsum("rd,rd->r", x, x))
        x32 = x.astype(np.float32)
        longest = size_x.max()
        single = metric == "ip" and longest < LONGEST
        for at in pieces(len(q), len(xi)):
            bar = held.bar(at)
            if single and (bar > -np.inf).all() and size_q[at].max() < LONGEST:
                lowest = bar - (q.shape[1] + 8) * SINGLE * size_q[at] * longest - 1e-9
                s = q32[at] @ x32.T
            else:
                s = q[at] @ x.T
                if metric == "l2":
                    s = 2 * s - (size_q[at] ** 2)[:, None] - (size_x**2)[None]
                s[np.isnan(s)] = -np.inf
                if skip_self:
                    s[same(qi[at], xi)] = -np.inf
                lowest = held.lowest(at, s)
                lowest = lowest - 1e-9 - 1e-12 * (size_q[at] + longest) ** 2
            r, c = np.nonzero(s >= np.nextafter(lowest.astype(s.dtype), s.dtype.type(-np.inf))[:, None])
            if skip_self:
                other = qi[at][r] != xi[c]
                r, c = r[other], c[other]
            if not len(r):
                continue
            held.add(at, r, xi[c], _exact(q[at], x, r, c, metric))
    return held.batch(qi)


def top_k(queries: DataFrame, index: DataFrame, k: int, metric: str = "ip", skip_self: bool = False, block: int = BLOCK, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """i, j, score, rank (from 1): the ``k`` nearest rows of ``index`` for each row of ``queries``.

    ``ip`` scores are inner products, ``l2`` scores negative squared distances.
    Equal scores (to ten decimals) rank by id.  ``skip_self`` leaves out the row
    with the query's own id.  Fewer than ``k`` rows give fewer neighbours.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if metric not in ("ip", "l2"):
        raise ValueError(f"unknown metric '{metric}'")
    passing = source(index, block, broadcast_numbers)

    def work(_: pa.RecordBatch, ids: np.ndarray, q: np.ndarray, blocks: Blocks) -> Iterator[pa.RecordBatch]:
        yield best(ids, q, blocks(), k, metric, skip_self)

    return ranked(meet(queries.select("id", "x"), passing, work, _OUT), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of (i, j, score) for each i, with ranks."""
    w = Window.partitionBy("i").orderBy(F.col("score").desc(), F.col("j"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def including_self(vectors: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """The k nearest rows and the row itself among them: k + 1 neighbours."""
    return top_k(vectors, vectors, k + 1, metric)


def without_self(vectors: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """The k nearest other rows; the row itself is left out by its id, also among equal vectors."""
    return top_k(vectors, vectors, k, metric, skip_self=True)


def short_rows(neighbors: DataFrame, k: int) -> DataFrame:
    """Rows with fewer than k neighbours: i, n."""
    return neighbors.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k)


def sampled(neighbors: DataFrame, draws: int = 1, seed: int = 0) -> DataFrame:
    """``draws`` neighbours of each row, chosen by a hash of pair and seed: i, j, draw."""
    key = F.md5(F.concat_ws("|", F.lit(seed), "i", "j"))
    w = Window.partitionBy("i").orderBy(key, "j")
    return neighbors.select("i", "j", F.row_number().over(w).alias("draw")).where(F.col("draw") <= draws)


def gather(ids: DataFrame, vectors: DataFrame, key: str = "j") -> DataFrame:
    """``ids`` with the vector of the id in column ``key``."""
    return ids.join(vectors.select(F.col("id").alias(key), "x"), key)


def density(vectors: DataFrame, k: int) -> DataFrame:
    """Representativeness of unit vectors: id, value = -ln of the sum of 2 - 2 s over the k nearest others, floored at 1e-8."""
    near = without_self(vectors, k)
    return near.groupBy(F.col("i").alias("id")).agg((-F.log(F.greatest(F.sum(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))), F.lit(1e-8)))).alias("value"))


def unit_table(vectors: DataFrame, floor: float = 1e-12) -> DataFrame:
    """The table with unit vectors, other columns unchanged."""
    return vectors.withColumn("x", unit("x", floor))

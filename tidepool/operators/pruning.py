"""Exact bounds for cosine search: what cannot reach a score is neither shipped nor multiplied.

* **Balls.** A bounded sample of the index gives pivots. A row belongs to its nearest pivot's
  ball, at an angle to the pivot. By the triangle inequality on the sphere, a query at angle t
  to the pivot is at least ``max(t - high, low - t)`` away from every row whose angle lies in
  ``[low, high]``, so a group whose cosine of that gap is below the query's floor is not needed.
* **Prefix bound.** Unit vectors are rotated onto the sample's leading axes. With h the first
  components and r the norm of the rest, Cauchy-Schwarz gives ``q.x <= hq.hx + rq*rx``; a
  block of pairs whose bounds are all below the floors is skipped before its product, and the
  product of another one is taken over the rows and columns with a bound above.
* **Floors.** A query's floor is the threshold, or its k-th best score in the sample (a part of
  the index, so the true k-th best is no lower), or what the kernel has found so far.

All bounds are lowered by ``SLACK`` against rounding; results stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import SparkContext

SLACK = 1e-9
MAX_AXES = 32
MIN_PRUNED_ROWS = 32  # a smaller block is multiplied at once
#: Rows are compared with the sample, the pivots or the groups in runs of at most that many pairs: one run bounds the memory.
RUN_PAIRS = 1 << 20


class Counters:
    """What a search did: cells scored, blocks looked at and skipped, pairs multiplied, rows shipped to cells."""

    NAMES = ("cells", "blocks", "skipped", "pairs", "query_rows", "index_rows")

    def __init__(self, sc: SparkContext):
        self.of = {n: sc.accumulator(0) for n in self.NAMES}

    def add(self, name: str, n: int) -> None:
        self.of[name].add(int(n))

    def values(self) -> dict[str, int]:
        return {n: a.value for n, a in self.of.items()}


def units(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def single_slack(dim: int) -> float:
    """How far a single-precision product of two vectors of at most unit length may be off: rounded inputs, then sums of ``dim`` terms."""
    return (dim + 8) * 2.0**-23 + SLACK


def runs(n: int, width: int) -> Iterator[slice]:
    """n rows in runs that, against ``width`` others each, are at most RUN_PAIRS pairs (one row at least)."""
    step = max(1, RUN_PAIRS // max(1, width))
    for i in range(0, n, step):
        yield slice(i, min(n, i + step))


def leading_axes(sample: np.ndarray) -> np.ndarray | None:
    """Orthonormal columns that hold most of the sample's unit vectors; None if a prefix would be no shorter."""
    dim = sample.shape[1]
    n = min(MAX_AXES, dim // 4)
    if n < 1 or not len(sample):
        return None
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :n].copy()


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of the sample, each the farthest from those before it."""
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        far = int(np.argmin(nearest))
        if nearest[far] >= 1 - SLACK:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, sample @ sample[far])
    return sample[chosen]


@dataclass
class Model:
    """The sample of the index (ids, order values, unit vectors), its axes and pivots."""

    ids: np.ndarray
    ords: np.ndarray
    sample: np.ndarray
    axes: np.ndarray | None
    pivots: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, ords: np.ndarray, vectors: np.ndarray, balls: int) -> Model:
        u = units(vectors)
        return cls(ids, ords, u, leading_axes(u), spread_pivots(u, balls))

    def angles(self, u: np.ndarray) -> np.ndarray:
        """Unit vectors' angles to all pivots; the caller passes one run of rows."""
        return np.arccos(np.clip(u @ self.pivots.T, -1.0, 1.0))

    def place(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each unit vector's ball (its nearest pivot) and its angle to that pivot."""
        ball, angle = np.empty(len(u), np.int64), np.empty(len(u))
        for run in runs(len(u), len(self.pivots)):
            angles = self.angles(u[run])
            ball[run] = angles.argmin(axis=1)
            angle[run] = angles.min(axis=1)
        return ball, angle

    def floors(self, u: np.ndarray, ords: np.ndarray, k: int, earlier_only: bool, least: float) -> np.ndarray:
        """A lower bound of each query's k-th best score, ``least`` or more."""
        out = np.full(len(u), float(least))
        n = len(self.sample)
        if n < k:
            return out
        sample = self.sample.T.astype(np.float32)
        for run in runs(len(u), n):
            s = u[run].astype(np.float32) @ sample
            if earlier_only:
                s[self.ords[None, :] >= ords[run, None]] = -np.inf
            kth = s.max(axis=1) if k == 1 else np.partition(s, n - k, axis=1)[:, n - k]
            out[run] = np.maximum(kth - single_slack(u.shape[1]), least)
        return out


@dataclass
class Groups:
    """Groups of index rows: ball, angles and order values that occur in it; ``first`` numbers their parts."""

    ball: np.ndarray
    low: np.ndarray
    high: np.ndarray
    earliest: np.ndarray
    first: np.ndarray  # one more at the end

    def needed(self, angles: np.ndarray, floors: np.ndarray, ords: np.ndarray, earlier_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, group) for every group that may hold a row at or above the query's floor; the caller passes one run of queries."""
        t = angles[:, self.ball]
        gap = np.maximum(np.maximum(t - self.high, self.low - t) - SLACK, 0.0)
        need = np.cos(gap) >= floors[:, None] - SLACK
        if earlier_only:
            need &= self.earliest[None, :] < ords[:, None]
        return np.nonzero(need)


def heads(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The first components in the axes and, last, the norm of the rest; the product of two such rows bounds that of the vectors."""
    h = u @ axes
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", h, h)))
    return np.concatenate([h, rest[:, None]], axis=1).astype(np.float32)

"""Greedy k-means++ seeding over a DataFrame."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from ..functions.kernels import least_distance, quick_distances, uniform_hash
from ..plans.partials import reduced
from ..sources.points import Points, blocks_of


def _first(ring: np.ndarray, rate: np.ndarray, x: np.ndarray) -> tuple[tuple[bool, float], np.ndarray]:
    """((without weight, time), row) of the first clock to ring; rows of rate 0 only if there are no others."""
    with np.errstate(divide="ignore"):
        time = np.divide(ring, rate)
    i = int(time.argmin())
    weightless = not rate[i] > 0
    if weightless:
        i = int(ring.argmin())
    return (weightless, float(ring[i] if weightless else time[i])), x[i]


def _round(points: Points, chosen: np.ndarray, candidates: np.ndarray, salt: int, trials: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sums, draws): what each candidate would leave, were it chosen.

    A candidate's sum is that of the squared distances of all rows to the nearest
    seed; its draws are ``trials`` rows drawn in proportion to those distances. Every
    row draws an exponential clock of that rate for each trial, from a hash of its
    place; the first to ring wins. Without a distance all rows are alike. One pass; a
    task sends on a sum and one row a trial for each candidate.
    """
    mean, width = points.mean, points.width

    def task(batches: Iterator[pa.RecordBatch]):
        at, total = 0, None
        part = TaskContext.get().partitionId()
        for x in blocks_of(batches, width, mean):
            ids = np.arange(at, at + len(x), dtype=np.int64) + (part << 40)
            at += len(x)
            rings = [-np.log(uniform_hash(ids, salt * 1000 + trial)) for trial in range(trials)]
            near = least_distance(x, chosen) if len(chosen) else np.full(len(x), np.inf)
            found = []
            for distance in np.minimum(near[:, None], quick_distances(x, candidates)).T:
                found.append((float(distance.sum()), [_first(ring, distance, x) for ring in rings]))
            total = found if total is None else merge([total, found])
        return total

    def merge(parts: list):
        out = []
        for options in zip(*parts, strict=True):
            drawn = [min(rows, key=lambda row: row[0]) for rows in zip(*(d for _, d in options), strict=True)]
            out.append((sum(s for s, _ in options), drawn))
        return out

    found = reduced(points.blocks, task, merge)
    return np.array([s for s, _ in found]), [np.array([x for _, x in drawn]) for _, drawn in found]


def _any_row(points: Points, salt: int) -> np.ndarray:
    """A row at random."""
    mean, width = points.mean, points.width

    def task(batches: Iterator[pa.RecordBatch]):
        at, best = 0, None
        part = TaskContext.get().partitionId()
        for x in blocks_of(batches, width, mean):
            place = uniform_hash(np.arange(at, at + len(x), dtype=np.int64) + (part << 40), salt * 1000 + 999)
            at += len(x)
            i = int(place.argmin())
            best = min([*([best] if best else []), (float(place[i]), x[i])], key=lambda row: row[0])
        return best

    return reduced(points.blocks, task, lambda parts: min(parts, key=lambda row: row[0]))[1]


def seeds(points: Points, k: int, seed: int | None) -> np.ndarray:
    """k centered seeds: the first a row at random, each next the best of 2 + floor(ln k) draws.

    One pass a seed: the pass that scores the candidates also draws what would come
    next after each of them.
    """
    salt = int(np.random.default_rng(seed).integers(1 << 40))
    trials = 2 + int(math.log(k))
    chosen = np.zeros((0, points.width))
    candidates = _any_row(points, salt)[None]
    for i in range(k):
        sums, draws = _round(points, chosen, candidates, salt + i, trials)
        best = int(sums.argmin())
        chosen = np.vstack([chosen, candidates[best]])
        candidates = draws[best]
    return chosen

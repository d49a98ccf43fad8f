"""Partitional clustering: k-means, fuzzy, entropic, rough and rough-membership c-means.

Training runs one narrow pass an iteration: tasks assign their rows and send on
weighted sums of a unit's size. Applying trained centers is the same assignment
once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.checks import LEAST
from ..functions.kernels import Entropic, Fuzzy, Hard, Rough, nearest
from ..plans.engine import Method, Step, Steps, Until, iterate
from ..plans.partials import reduced
from ..sources.points import Points, blocks_of, prepared, rows_of
from .neighbors import around, by_row, edge_count, ones, tiled
from .seeding import seeds

LABELLED = "label int, membership array<double>"


def moved(centers: np.ndarray, mean: np.ndarray, weighted: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Means of centered rows in input coordinates; a center without mass stays as it is."""
    out = centers.copy()
    some = mass > 0
    out[some] = weighted[some] / mass[some, None] + mean
    return out


def with_column(df: DataFrame, step: Callable[[pa.RecordBatch, np.ndarray], dict], kinds: dict[str, str], width: int) -> DataFrame:
    """df's row_id with columns that ``step`` computes from a batch and its matrix."""
    arrow = {"int": pa.int32(), "array<double>": pa.list_(pa.float64()), "double": pa.float64()}
    row_id = df.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in rows_of(batches, width):
            found = step(batch, x)
            arrays = [batch.column("row_id")]
            for name, kind in kinds.items():
                value = found[name]
                if kind == "array<double>" and isinstance(value, np.ndarray):
                    offsets = np.arange(len(value) + 1, dtype=np.int32) * value.shape[1]
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(value, np.float64).ravel())))
                else:
                    arrays.append(pa.array(value, arrow[kind]))
            yield pa.RecordBatch.from_arrays(arrays, ["row_id", *kinds])

    return df.mapInArrow(run, ", ".join([f"row_id {row_id}", *(f"{n} {k}" for n, k in kinds.items())]))


def assigned(points: Points, assign, centers: np.ndarray) -> DataFrame:
    """(row_id, label[, membership]) for fixed centers."""
    v, mean = centers - points.mean, points.mean

    def step(_, x: np.ndarray) -> dict:
        if not assign.soft:
            return {"label": nearest(x - mean, v)[0]}
        held, _ = assign(assign.distances(x - mean, v))
        return {"label": held.argmax(axis=1), "membership": held}

    kinds = {"label": "int", "membership": "array<double>"} if assign.soft else {"label": "int"}
    return with_column(points.df, step, kinds, points.width)


def unit_sums(points: Points, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of centered rows and counts by nearest unit, and the sum of least squared distances."""
    v, mean, width = centers - points.mean, points.mean, points.width

    def task(batches: Iterator[pa.RecordBatch]):
        total = None
        for x in blocks_of(batches, width, mean):
            label, least = nearest(x, v)
            weighted = np.stack([np.bincount(label, x[:, d], len(v)) for d in range(width)], axis=1)
            part = (weighted, np.bincount(label, minlength=len(v)).astype(float), np.array(least.sum()))
            total = part if total is None else tuple(a + b for a, b in zip(total, part, strict=True))
        return total

    return reduced(points.blocks, task)


def hard_step(points: Points, centers: np.ndarray, _, t: int) -> Step:
    weighted, mass, value = unit_sums(points, centers)
    return Step(moved(centers, points.mean, weighted, mass), objective=float(value))


def soft_merge(m: float | None):
    """Merges soft sums (weighted, mass, objective, top) of several parts of the rows.

    Powers are scaled by each unit's largest membership, top, so that they don't
    vanish; merging brings partial sums to the larger scale.
    """

    def merge(parts: list):
        top = np.max([p[3] for p in parts], axis=0)
        total = [np.zeros_like(x) for x in parts[0][:3]]
        for weighted, mass, value, part_top in parts:
            factor = (part_top / np.maximum(top, LEAST)) ** m if m else np.ones_like(top)
            total = [total[0] + weighted * factor[:, None], total[1] + mass * factor, total[2] + value]
        return (*total, top)

    return merge


def soft_sums(points: Points, centers: np.ndarray, assign, m: float | None = None) -> tuple:
    """Sums of centered rows and masses, weighted by memberships or their m-th powers; objective; top."""
    v, mean, width, merge = centers - points.mean, points.mean, points.width, soft_merge(m)

    def task(batches: Iterator[pa.RecordBatch]):
        parts = []
        for x in blocks_of(batches, width, mean):
            held, value = assign(assign.distances(x, v))
            top = held.max(axis=0) if m else np.ones(len(v))
            weight = (held / np.maximum(top, LEAST)) ** m if m else held
            part = (weight.T @ x, weight.sum(axis=0), np.array(np.nan if value is None else value), top)
            parts = [merge([*parts, part])]
        return parts[0] if parts else None

    return reduced(points.blocks, task, merge)


def soft_step(assign, m: float | None = None) -> Callable[..., Step]:
    """Means weighted by memberships, or by their m-th powers."""

    def step(points: Points, centers: np.ndarray, _, t: int) -> Step:
        weighted, mass, value, _ = soft_sums(points, centers, assign, m)
        return Step(moved(centers, points.mean, weighted, mass), objective=checked(assign, float(value)))

    return step


@dataclass(frozen=True)
class Partial:
    """What one site's rows add to an update: sums about ``origin``, masses, objective.

    It has the size of the prototypes and holds no row. ``top`` and ``m`` belong to
    the scale of fuzzy sums.
    """

    weighted: np.ndarray
    mass: np.ndarray
    objective: float | None
    origin: np.ndarray
    top: np.ndarray
    m: float | None


def partial_update(df: DataFrame, centers, *, features, id_col: str = "row_id", m: float | None = None, tau: float | None = None) -> Partial:
    """One site's part of an update of k-means, of fuzzy c-means (``m``) or of its entropic form (``tau``)."""
    if m is not None and tau is not None:
        raise ValueError("an update is fuzzy (m) or entropic (tau), not both")
    points, centers = fixed(df, centers, {"features": features, "id_col": id_col})
    origin = centers.mean(axis=0)
    if m is None and tau is None:
        weighted, mass, value = unit_sums(points, centers)
        top = np.ones(len(centers))
    else:
        weighted, mass, value, top = soft_sums(points, centers, fuzzy(m) if tau is None else entropic(tau), m)
    points.release()
    return Partial(weighted + mass[:, None] * (points.mean - origin), mass, float(value), origin, top, m)


def merged_update(parts: list[Partial], centers) -> tuple[np.ndarray, float]:
    """(centers, objective) of all sites' rows; a center without mass stays as it is."""
    centers = checks.matrix(centers, "centers")
    if not parts or any(p.m != parts[0].m or not np.array_equal(p.origin, centers.mean(axis=0)) for p in parts):
        raise ValueError("parts must be of one method and of these centers")
    weighted, mass, value, _ = soft_merge(parts[0].m)([(p.weighted, p.mass, np.array(p.objective), p.top) for p in parts])
    return moved(centers, parts[0].origin, weighted, mass), float(value)


def checked(assign, value: float) -> float | None:
    """The objective; None of a method without one, an error where it overflows."""
    if isinstance(assign, Entropic) and not np.isfinite(value):
        raise ValueError(f"tau = {assign.tau:g} is too large: the objective overflows double")
    return None if np.isnan(value) else value


def started(df: DataFrame, k: int, init, seed: int | None, source: dict, ready=lambda points: points) -> tuple[Points, np.ndarray]:
    """Points and initial centers; what can be checked without the data is checked first."""
    k = checks.whole(k, "k", 1)
    if isinstance(init, str) and init != "k-means++":
        raise ValueError(f"init is neither 'k-means++' nor a matrix of k rows: {init!r}")
    seed = checks.seed(seed)
    given = None if isinstance(init, str) else checks.matrix(init, "init")
    points = ready(prepared(df, **source))
    checks.whole(k, "k", 1, points.n)
    if given is not None:
        if given.shape != (k, points.width):
            raise ValueError(f"init has shape {given.shape}; k and the features ask for ({k}, {points.width})")
        return points, given
    # Seeds lie on rows; their cell means keep a large m from stalling there.
    first = seeds(points, k, seed) + points.mean
    return points, hard_step(points, first, None, 0).centers


def fixed(df: DataFrame, centers, source: dict, units: int | None = None, ready=lambda points: points) -> tuple[Points, np.ndarray]:
    """Points and trained centers, as given."""
    centers = checks.matrix(centers, "centers")
    if units is not None and len(centers) != units:
        raise ValueError(f"centers must have {units} rows, one per unit")
    points = ready(prepared(df, **source))
    if centers.shape[1] != points.width:
        raise ValueError(f"centers must have {points.width} columns, like X")
    return points, centers


def _trained(df, k, assign, m, init, until, seed, features, id_col) -> Steps:
    source = {"features": features, "id_col": id_col}
    points, centers = started(df, k, init, seed, source)
    advance = soft_step(assign, m) if assign.soft else hard_step
    method = Method(advance, lambda points, before, after, carry: assigned(points, assign, before), until, source=source)
    return (yield from iterate(method, points, centers))


def _applied(df, centers, assign, features, id_col, m: float | None = None) -> Steps:
    source = {"features": features, "id_col": id_col}
    points, centers = fixed(df, centers, source)

    def advance(points: Points, centers: np.ndarray, _, t: int) -> Step:
        step = (soft_step(assign, m) if assign.soft else hard_step)(points, centers, None, t)
        return replace_centers(step, centers)

    method = Method(advance, lambda points, before, after, carry: assigned(points, assign, before), Until(length=1), source=source, fixed=True)
    return (yield from iterate(method, points, centers))


def replace_centers(step: Step, centers: np.ndarray) -> Step:
    return replace(step, centers=centers)


def kmeans(df: DataFrame, k: int, *, features, id_col: str = "row_id", init="k-means++", max_iter: int | None = 300, seed: int | None = None) -> Steps:
    """Lloyd's k-means to its fixed point; ties go to the lowest center, an empty one stays."""
    until = Until(limit=checks.limit(max_iter))
    return (yield from _trained(df, k, Hard(), None, init, until, seed, features, id_col))


def fuzzy(m: float) -> Fuzzy:
    return Fuzzy(checks.number(m, "m", 1.0, above=True))


def entropic(tau: float) -> Entropic:
    return Entropic(checks.number(tau, "tau", 0.0, above=True))


def rough(alpha: float, beta: float, p: float) -> Rough:
    return Rough(checks.number(alpha, "alpha", 1.0), checks.number(beta, "beta", 0.0), checks.number(p, "p", 0.0, above=True))


def fcm(
    df: DataFrame, k: int, *, features, id_col: str = "row_id", m: float = 2.0, init="k-means++",
    max_iter: int | None = 300, tol: float = 1e-6, seed: int | None = None,
) -> Steps:
    """Fuzzy c-means; ends when no center moves more than tol times the radius of the data."""
    assign = fuzzy(m)
    until = Until(tol=checks.number(tol, "tol", 0.0), limit=checks.limit(max_iter))
    return (yield from _trained(df, k, assign, assign.m, init, until, seed, features, id_col))


def efcm(
    df: DataFrame, k: int, *, features, id_col: str = "row_id", tau: float = 1.0, init="k-means++",
    max_iter: int | None = 300, tol: float = 1e-6, seed: int | None = None,
) -> Steps:
    """Entropy-regularized fuzzy c-means."""
    assign = entropic(tau)
    until = Until(tol=checks.number(tol, "tol", 0.0), limit=checks.limit(max_iter))
    return (yield from _trained(df, k, assign, None, init, until, seed, features, id_col))


def rcm(
    df: DataFrame, k: int, *, features, id_col: str = "row_id", alpha: float = 1.1, beta: float = 0.0, p: float = 1.0,
    init="k-means++", max_iter: int | None = 300, seed: int | None = None,
) -> Steps:
    """Rough c-means; p other than 1 gives the extended form."""
    assign = rough(alpha, beta, p)
    return (yield from _trained(df, k, assign, None, init, Until(limit=checks.limit(max_iter)), seed, features, id_col))


def apply_kmeans(df: DataFrame, centers, *, features, id_col: str = "row_id") -> Steps:
    """Labels by the nearest of trained centers."""
    return (yield from _applied(df, centers, Hard(), features, id_col))


def apply_fcm(df: DataFrame, centers, *, m: float, features, id_col: str = "row_id") -> Steps:
    """Fuzzy memberships for trained centers."""
    assign = fuzzy(m)
    return (yield from _applied(df, centers, assign, features, id_col, assign.m))


def apply_efcm(df: DataFrame, centers, *, tau: float, features, id_col: str = "row_id") -> Steps:
    """Entropic memberships for trained centers."""
    return (yield from _applied(df, centers, entropic(tau), features, id_col))


def apply_rcm(df: DataFrame, centers, *, alpha: float, beta: float, p: float, features, id_col: str = "row_id") -> Steps:
    """Rough memberships for trained centers."""
    return (yield from _applied(df, centers, rough(alpha, beta, p), features, id_col))


@dataclass(frozen=True)
class Neighborhoods(Points):
    """Points in tiles, whose rows have all rows within ``delta`` as neighbours, themselves included.

    ``joined`` has for each row j what it adds to a unit it is nearest to: the sum of
    x_i / degree_i over its neighbours i, and that of 1 / degree_i. These are added up
    once, not at every iteration; where nothing is trained there are none.
    """

    delta: float = 0.0
    tiles: DataFrame = None
    degrees: DataFrame | None = None
    joined: DataFrame | None = None

    def release(self) -> None:
        super().release()
        for df in (self.degrees, self.joined):
            if df is not None:
                df.unpersist()


def neighborhoods(delta: float, max_edges: int | None, trains: bool) -> Callable[[Points], Neighborhoods]:
    delta = checks.number(delta, "delta", 0.0)
    max_edges = None if max_edges is None else checks.whole(max_edges, "max_edges", 1)

    def ready(points: Points) -> Neighborhoods:
        mean, width = points.mean, points.width
        tiles, degrees, joined = tiled(points), None, None
        if trains or max_edges is not None:
            degrees = around(tiles, delta, width, ones).persist(StorageLevel.MEMORY_AND_DISK)
        if max_edges is not None and edge_count(degrees) > max_edges:
            degrees.unpersist()
            points.release()
            raise ValueError(f"delta={delta} gives more than max_edges={max_edges} edges")

        def shared(x: np.ndarray, degree: np.ndarray) -> np.ndarray:
            return np.column_stack([x - mean, np.ones(len(x))]) / degree[:, None]

        if trains:
            carried = degrees.select("tile", "ids", "x", F.col("sums").alias("w"))
            joined = around(carried, delta, width, shared).persist(StorageLevel.MEMORY_AND_DISK)
        return Neighborhoods(points.df, points.n, mean, points.radius, points.blocks, points.span, delta, tiles, degrees, joined)

    return ready


def _rough_membership(points: Neighborhoods, centers: np.ndarray, _, t: int) -> Step:
    v, mean, width = centers - points.mean, points.mean, points.width

    def task(batches: Iterator[pa.RecordBatch]):
        total = None
        for batch, x in rows_of(batches, width, mean):
            added = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, width + 1)
            label, _ = nearest(x, v)
            sums = np.stack([np.bincount(label, added[:, d], len(v)) for d in range(width + 1)], axis=1)
            part = (sums[:, :width], sums[:, width])
            total = part if total is None else (total[0] + part[0], total[1] + part[1])
        return total

    return Step(moved(centers, mean, *reduced(points.joined.select("x", "sums"), task)))


def _neighbor_memberships(points: Neighborhoods, centers: np.ndarray) -> DataFrame:
    """(row_id, label, membership): shares of the labels among each row's neighbours."""
    v, mean, k = centers - points.mean, points.mean, len(centers)

    def labelled(x: np.ndarray, _) -> np.ndarray:
        out = np.zeros((len(x), k))
        out[np.arange(len(x)), nearest(x - mean, v)[0]] = 1.0
        return out

    def shown(counts: np.ndarray) -> list[pa.Array]:
        held = counts / counts.sum(axis=1, keepdims=True)
        offsets = pa.array(np.arange(len(held) + 1, dtype=np.int32) * k)
        return [pa.array(held.argmax(axis=1), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(held.ravel()))]

    return by_row(around(points.tiles, points.delta, points.width, labelled), shown, LABELLED, k)


def rmcm(
    df: DataFrame, k: int, *, delta: float, features, id_col: str = "row_id", init="k-means++",
    max_iter: int | None = 300, max_edges: int | None = None, seed: int | None = None,
) -> Steps:
    """Rough membership c-means: shares of the nearest centers within distance delta, inclusive.

    No edge is held, so that their number needs no bound; with ``max_edges`` more are refused.
    """
    ready = neighborhoods(delta, max_edges, True)
    source = {"features": features, "id_col": id_col}
    until = Until(limit=checks.limit(max_iter))
    points, centers = started(df, k, init, seed, source, ready)
    method = Method(_rough_membership, lambda points, before, after, carry: _neighbor_memberships(points, before), until, ready, source=source)
    return (yield from iterate(method, points, centers))


def apply_rmcm(df: DataFrame, centers, *, delta: float, features, id_col: str = "row_id", max_edges: int | None = None) -> Steps:
    """Rough memberships for trained centers, within the rows given; ``max_edges`` as in rmcm."""
    ready = neighborhoods(delta, max_edges, False)
    source = {"features": features, "id_col": id_col}
    points, centers = fixed(df, centers, source, ready=ready)
    method = Method(
        lambda points, centers, carry, t: Step(centers), lambda points, before, after, carry: _neighbor_memberships(points, before),
        Until(length=1), ready, source=source, fixed=True,
    )
    return (yield from iterate(method, points, centers))

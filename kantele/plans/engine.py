"""The loop that every iterative method runs in, one Spark job an iteration."""

from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass, field
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame

from ..sources.points import Points, prepared


@dataclass(frozen=True)
class Result:
    """What a run has reached.

    ``centers`` (K, D) are the prototypes after the last update. ``assignments`` is a
    lazy DataFrame (row_id, label[, membership][, embedding]). For clusterings and
    som_olp it belongs to the prototypes before the last update; for som and
    batch_som to the final ones. ``history`` has the objective at each assignment.
    ``stop_reason`` is tol, schedule, limit or None.
    """

    centers: np.ndarray
    assignments: DataFrame
    n_iter: int
    stop_reason: str | None
    history: np.ndarray
    unit_coordinates: np.ndarray | None = None


@dataclass(frozen=True)
class Progress:
    """One iteration; result() is what the run would return had it ended here."""

    iteration: int
    result: Callable[[], Result]


@dataclass(frozen=True)
class Until:
    """When a run ends: a length, or a tolerance with or without a limit.

    ``what`` the tolerance is held against: moved centers (times the radius of the
    data) or changed memberships.
    """

    length: int | None = None
    tol: float = 0.0
    limit: int | None = None
    memberships: bool = False

    def reason(self, t: int, moved: float, changed: float | None, radius: float) -> str | None:
        if self.length is not None:
            return "schedule" if t == self.length else None
        held = changed is not None and changed <= self.tol if self.memberships else moved <= self.tol * radius
        return "tol" if held else "limit" if t == self.limit else None

    def last(self, t: int) -> bool:
        return t == (self.limit if self.length is None else self.length)


@dataclass
class Step:
    """What one iteration gives: new centers, carried state, objective and change of memberships."""

    centers: np.ndarray
    carry: object = None
    objective: float | None = None
    changed: float | None = None


@dataclass
class Method:
    """advance(points, centers, carry, t) -> Step; shown(points, before, after, carry_before) -> DataFrame.

    ``ready`` prepares points for the method (a neighbourhood graph); ``kept`` says
    which state carries over to new points.
    """

    advance: Callable[..., Step]
    shown: Callable[..., DataFrame]
    until: Until
    ready: Callable[[Points], Points] = lambda points: points
    kept: Callable[[object, Points, Points], object] = lambda carry, old, new: None
    units: np.ndarray | None = None
    fixed: bool = False
    source: dict = field(default_factory=dict)


Steps = Generator[Progress, DataFrame | None, Result]


def iterate(method: Method, points: Points, centers: np.ndarray) -> Steps:
    """Runs a method; a DataFrame sent in becomes the data of the next iteration.

    Centers carry over to new data, the schedule goes on. The run ends at its limit
    or the end of its schedule even if data are sent; at the tolerance only without.
    """
    carry, history, t = None, [], 0
    while True:
        step = method.advance(points, centers, carry, t)
        t += 1
        if step.objective is not None:
            history.append(step.objective)
        moved = float(np.abs(step.centers - centers).max())
        reason = method.until.reason(t, moved, step.changed, points.radius)

        def result(t=t, points=points, before=centers, after=step.centers, carry=carry, reason=reason, seen=tuple(history)) -> Result:
            frame = method.shown(points, before, after, carry)
            units = None if method.units is None else method.units.copy()
            return Result(after.copy(), frame, t, reason, np.array(seen, float), units)

        rows = yield Progress(t, result)
        if method.until.last(t):
            points.release()
            return result()
        if rows is not None:
            new = method.ready(prepared(rows, **method.source, width=centers.shape[1]))
            carry = method.kept(step.carry, points, new)
            points.release()
            points = new
        elif reason == "tol":
            points.release()
            return result()
        else:
            carry = step.carry
        if not method.fixed:
            centers = step.centers


def to_end(steps: Callable[..., Steps]) -> Callable[..., Result]:
    """The function that runs a generator to its end."""

    @wraps(steps)
    def run(*args, **kwargs) -> Result:
        going = steps(*args, **kwargs)
        while True:
            try:
                next(going)
            except StopIteration as end:
                return end.value

    return run

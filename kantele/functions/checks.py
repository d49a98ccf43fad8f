"""Checks of parameters. They come before any work on data."""

from __future__ import annotations

import math
from numbers import Integral, Real

import numpy as np

#: The largest integer that a double holds exactly with all below it.
MOST = 2**53 - 1
#: The data contract: squared norms below, and a span in some feature of at least.
MOST_SQUARED, LEAST_SPAN = 1e300, 1e-150
#: The least positive normal double.
LEAST = float(np.finfo(np.float64).tiny)


def whole(value, name: str, low: int, high: int | None = None) -> int:
    """An integer in [low, high]."""
    top = MOST if high is None else min(high, MOST)
    if isinstance(value, (bool, np.bool_)) or not isinstance(value, Integral) or not low <= int(value) <= top:
        raise ValueError(f"{name} must be an integer " + (f">= {low}" if high is None else f"in [{low}, {high}]"))
    return int(value)


def number(value, name: str, low: float | None = None, above: bool = False) -> float:
    """A finite number, not below ``low``, or above it."""
    fits = isinstance(value, Real) and not isinstance(value, (bool, np.bool_)) and math.isfinite(value)
    if not fits or low is not None and (value <= low if above else value < low):
        raise ValueError(f"{name} must be a finite number" + ("" if low is None else f" {'>' if above else '>='} {low}"))
    return float(value)


def flag(value, name: str) -> bool:
    if not isinstance(value, (bool, np.bool_)):
        raise ValueError(f"{name} must be a boolean")
    return bool(value)


def seed(value) -> int | None:
    return None if value is None else whole(value, "seed", 0)


def limit(value) -> int | None:
    """max_iter: a positive integer, or None for no limit."""
    return None if value is None else whole(value, "max_iter", 1)


def in_scale(most_squared: float, span: float, name: str, advice: str = "standardize it") -> None:
    """The data contract, from the largest squared norm and the largest feature span."""
    if not most_squared < MOST_SQUARED:
        raise ValueError(f"{name} is too large in scale for double distances; {advice}")
    if 0 < span < LEAST_SPAN:
        raise ValueError(f"{name} is too small in scale for double distances; {advice}")


def matrix(rows, name: str) -> np.ndarray:
    """A small driver-side matrix (centers, units) as doubles: numbers only, finite, in scale."""
    if isinstance(rows, (list, tuple)):
        if any(isinstance(v, (bool, np.bool_)) for row in rows if isinstance(row, (list, tuple, np.ndarray)) for v in row):
            raise TypeError(f"{name} must hold numbers, not booleans")
    found = np.array(rows)
    if found.dtype.kind not in "iuf":
        raise TypeError(f"{name} must hold numbers, not {found.dtype}")
    found = found.astype(np.float64)
    if found.ndim != 2 or not found.size:
        raise ValueError(f"{name} must be a non-empty matrix")
    if not np.isfinite(found).all():
        raise ValueError(f"{name} must hold finite values")
    in_scale(float((found**2).sum(axis=1).max()), float(np.ptp(found, axis=0).max()), name)
    return found

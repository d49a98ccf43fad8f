"""Trained maps and clusterings on disk."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession

from ..plans.engine import Result


@dataclass(frozen=True)
class Trained:
    """Centers, the coordinates of a map's units, and the settings to apply them with."""

    centers: np.ndarray
    unit_coordinates: np.ndarray | None = None
    settings: dict = field(default_factory=dict)


def save(spark: SparkSession, trained: Result | Trained, path: str, **settings) -> None:
    """Writes a folder of two small Parquet tables, ``units`` and ``settings``; any Spark path will do."""
    units = trained.unit_coordinates
    rows = [(i, c.tolist(), None if units is None else units[i].tolist()) for i, c in enumerate(trained.centers)]
    spark.createDataFrame(rows, "unit int, center array<double>, coord array<double>").coalesce(1).write.parquet(f"{path}/units")
    known = {**getattr(trained, "settings", {}), **settings}
    spark.createDataFrame([(json.dumps(known),)], "settings string").coalesce(1).write.parquet(f"{path}/settings")


def load(spark: SparkSession, path: str) -> Trained:
    rows = sorted(spark.read.parquet(f"{path}/units").collect(), key=lambda r: r["unit"])
    settings = json.loads(spark.read.parquet(f"{path}/settings").head()["settings"])
    units = None if rows[0]["coord"] is None else np.array([r["coord"] for r in rows])
    return Trained(np.array([r["center"] for r in rows]), units, settings)

"""Sums over all rows: a partial result of each task, merged in rounds of bounded groups."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial results that meet in one group, and that the driver merges at last.
GROUP = 64
SCHEMA = "part long, data binary"


def _row(part: int, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([pickle.dumps(data)], pa.binary())], ["part", "data"])


def sums(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The plain merge: element by element, in the order of the tasks."""
    total = parts[0]
    for part in parts[1:]:
        total = tuple(a + b for a, b in zip(total, part, strict=True))
    return total


def reduced(df: DataFrame, compute: Callable, merge: Callable = sums):
    """merge(partial results) of compute(batches) over every partition; None of no rows.

    ``compute`` returns None for a partition without rows. Partial results are always
    merged in the order of their partitions, so that equal data in equal partitions
    give equal bits.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := compute(batches)) is not None:
            yield _row(TaskContext.get().partitionId(), found)

    def group(key: tuple, found: pa.Table) -> pa.Table:
        rows = sorted(zip(found.column("part").to_pylist(), found.column("data").to_pylist(), strict=True))
        return pa.Table.from_batches([_row(key[0].as_py(), merge([pickle.loads(data) for _, data in rows]))])

    parts = df.rdd.getNumPartitions()
    found = df.mapInArrow(task, SCHEMA)
    while parts > GROUP:
        found = found.withColumn("part", F.expr(f"part div {GROUP}")).groupBy("part").applyInArrow(group, SCHEMA)
        parts = -(-parts // GROUP)
    rows = sorted((r["part"], bytes(r["data"])) for r in found.collect())
    return merge([pickle.loads(data) for _, data in rows]) if rows else None

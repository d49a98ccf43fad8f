"""Rows of numbers as the input of a method."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import checks
from ..plans.partials import reduced


def rows_of(batches: Iterator[pa.RecordBatch], width: int, mean: np.ndarray | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(batch, its rows as a matrix less the mean) of batches with a column ``x``."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield batch, x if mean is None else x - mean


def blocks_of(batches: Iterator[pa.RecordBatch], width: int, mean: np.ndarray) -> Iterator[np.ndarray]:
    """Centered matrices of a task's packed blocks."""
    for batch in batches:
        for data in batch.column("data"):
            yield np.frombuffer(data.as_buffer(), np.float64).reshape(-1, width) - mean


@dataclass(frozen=True)
class Points:
    """Checked rows: ``df`` has row_id and x (array of doubles).

    ``blocks`` has the same rows as binary matrices, persisted: an iteration reads
    them without a conversion for each row. ``mean``, ``radius`` (the root mean square
    norm about it) and ``span`` (of each feature) are driver-side.
    """

    df: DataFrame
    n: int
    mean: np.ndarray
    radius: float
    blocks: DataFrame
    span: np.ndarray

    @property
    def width(self) -> int:
        return len(self.mean)

    def release(self) -> None:
        self.blocks.unpersist()


def selected(df: DataFrame, features: list[str] | str, id_col: str) -> DataFrame:
    """(row_id, x) of numeric columns, or of one column of arrays of numbers."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if isinstance(features, str):
        kind = kinds[features]
        element = kind.elementType if isinstance(kind, T.ArrayType) else None
        if element is None or not isinstance(element, T.NumericType):
            raise TypeError(f"{features} must be an array of numbers, not {kind.simpleString()}")
        x = F.col(f"`{features}`").cast("array<double>")
    else:
        if not features:
            raise ValueError("features must name at least one column")
        for name in features:
            if not isinstance(kinds[name], T.NumericType):
                raise TypeError(f"{name} must hold numbers, not {kinds[name].simpleString()}")
        x = F.array(*(F.col(f"`{name}`").cast("double") for name in features))
    return df.select(F.col(f"`{id_col}`").alias("row_id"), x.alias("x"))


#: Bytes of a packed block.
BLOCK_BYTES = 1 << 20
PACKED = "data binary, width int, fault string, part int, nr int"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (data, width, fault) of a task's rows, numbered by task and place."""
    part, made = TaskContext.get().partitionId(), 0

    def row(data: bytes, width: int, fault: str | None) -> pa.RecordBatch:
        nonlocal made
        made += 1
        values = [pa.array([data], pa.binary()), pa.array([width], pa.int32()), pa.array([fault], pa.string()), pa.array([part], pa.int32()), pa.array([made], pa.int32())]
        return pa.RecordBatch.from_arrays(values, [x.split()[0] for x in PACKED.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        x, ids = batch.column("x"), batch.column("row_id")
        sizes = pc.list_value_length(x)
        fault, width = None, pc.max(sizes).as_py()
        if x.null_count or ids.null_count or x.flatten().null_count:
            fault = "null"
        elif pc.min(sizes).as_py() != width:
            fault = "width"
        elif not width:
            fault = "empty"
        if fault:
            yield row(b"", 0, fault)
            continue
        values = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        if not np.isfinite(values).all():
            yield row(b"", 0, "finite")
            continue
        step = max(1, BLOCK_BYTES // (8 * width))
        for i in range(0, len(values), step):
            yield row(np.ascontiguousarray(values[i : i + step]).tobytes(), width, None)


def _described(batches: Iterator[pa.RecordBatch]):
    """Count, sums, extremes and faults of one task's blocks."""
    total = None
    for batch in batches:
        for data, width, fault in zip(batch.column("data"), batch.column("width").to_pylist(), batch.column("fault").to_pylist(), strict=True):
            if fault:
                return {"fault": fault}
            x = np.frombuffer(data.as_buffer(), np.float64).reshape(-1, width)
            with np.errstate(over="ignore"):
                part = {"n": len(x), "sum": x.sum(axis=0), "low": x.min(axis=0), "high": x.max(axis=0), "norm": float((x**2).sum(axis=1).max())}
            total = part if total is None else _merged([total, part])
            if "fault" in total:
                return total
    return total


def _merged(parts: list[dict]) -> dict:
    total = dict(parts[0])
    for part in parts[1:]:
        for found in (total, part):
            if "fault" in found:
                return found
        if len(part["sum"]) != len(total["sum"]):
            return {"fault": "width"}
        total = {
            "n": total["n"] + part["n"], "sum": total["sum"] + part["sum"], "low": np.minimum(total["low"], part["low"]),
            "high": np.maximum(total["high"], part["high"]), "norm": max(total["norm"], part["norm"]),
        }
    return total


FAULTS = {
    "null": (TypeError, "must hold numbers and ids, not null"), "width": (ValueError, "must have rows of one length"),
    "empty": (ValueError, "must have at least one feature"), "finite": (ValueError, "must hold only finite values"),
}


def dealt(blocks: DataFrame) -> DataFrame:
    """Blocks of few partitions, such as those of one file, dealt to as many as there are cores, in order."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    if blocks.rdd.getNumPartitions() >= cores:
        return blocks
    place = F.pmod(F.col("nr") + F.col("part"), F.lit(cores))
    return blocks.repartitionById(cores, place).sortWithinPartitions("part", "nr")


def prepared(df: DataFrame, features: list[str] | str, id_col: str = "row_id", width: int | None = None) -> Points:
    """Packs the rows once, checks and describes them in two passes over the blocks.

    Null ids or values are a TypeError; ragged, empty, non-finite and out-of-scale
    rows, and no rows at all, are a ValueError.
    """
    points = selected(df, features, id_col)
    blocks = dealt(points.mapInArrow(_packed, PACKED)).persist(StorageLevel.MEMORY_AND_DISK)
    found = reduced(blocks, _described, _merged)
    if found is None:
        raise ValueError("X must have at least one row")
    if "fault" in found:
        blocks.unpersist()
        kind, said = FAULTS[found["fault"]]
        raise kind(f"X {said}")
    checks.in_scale(found["norm"], float((found["high"] - found["low"]).max()), "X")
    mean = found["sum"] / found["n"]
    if width is not None and len(mean) != width:
        raise ValueError(f"X must have {width} features, like the data the run started on")

    def spread(batches: Iterator[pa.RecordBatch]):
        total = None
        for x in blocks_of(batches, len(mean), mean):
            total = (total or 0.0) + float((x**2).sum())
        return None if total is None else (np.array(total),)

    radius = float(np.sqrt(reduced(blocks, spread)[0] / found["n"]))
    return Points(points, int(found["n"]), mean, radius, blocks, found["high"] - found["low"])

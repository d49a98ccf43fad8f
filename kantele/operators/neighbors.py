"""Sums over the rows within a distance of every row.

No pair of rows is ever written. Rows are sorted along a curve through the space and
cut into tiles, whose boxes say which tiles lie within the distance of each other: of a
tile that does so as a whole only its total is added, and only tiles that do so in part
are sent to each other. There leaves of few rows go by their boxes in the same way, and
rows are compared in what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import all_within, none_within, squared_gaps
from ..sources.points import Points, rows_of
from ..sources.shared import shared_folder

#: Rows of a tile, and of a leaf of it, at most.
TILE, LEAF = 4096, 64
#: Features that the curve goes by, the widest ones, and the bits of a place on it.
CURVE_FEATURES, CURVE_BITS = 6, 62

#: Weights of rows: (their matrix, what a tile carries for each, or None) -> (rows, sums).
Weigh = Callable[[np.ndarray, np.ndarray | None], np.ndarray]


def _floats(values: np.ndarray) -> pa.Array:
    """An array of one row, which holds all values."""
    flat = pa.array(np.ascontiguousarray(values, np.float64).ravel())
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


NONE = pa.nulls(1, pa.list_(pa.float64()))


def places(x: np.ndarray, mean: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Places of rows on a curve that takes the bits of their features in turn, in steps alike for all."""
    widest = np.argsort(-span, kind="stable")[:CURVE_FEATURES]
    bits = CURVE_BITS // len(widest)
    half = 1 << (bits - 1)
    cell = np.floor((x[:, widest] - mean[widest]) / ((float(span.max()) or 1.0) / half))
    cell = (cell.clip(-half, half - 1) + half).astype(np.int64)
    out = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for d in range(len(widest)):
            out = out << 1 | cell[:, d] >> bit & 1
    return out


def tiled(points: Points) -> DataFrame:
    """(tile, ids, x, w): neighbouring rows in one row; w, a number for each of them, is null.

    It is written by checkpoint(): what is in a tile must not change from pass to pass.
    """
    width, mean, span, spark = points.width, points.mean, points.span, points.df.sparkSession
    row_id = points.df.schema["row_id"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in rows_of(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(places(x, mean, span)), batch.column("row_id"), batch.column("x")], ["place", "row_id", "x"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                ids = batch.column("row_id").slice(at, TILE)
                x = batch.column("x").slice(at, TILE).flatten().to_numpy(zero_copy_only=False)
                held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int64()), held, _floats(x), NONE], ["tile", "ids", "x", "w"])
                tile += 1

    parts = max(spark.sparkContext.defaultParallelism, points.n >> 18)
    rows = points.df.mapInArrow(placed, f"place long, row_id {row_id}, x array<double>").repartitionByRange(parts, "place").sortWithinPartitions("place", "x")
    shared_folder(spark)
    return rows.mapInArrow(cut, f"tile long, ids array<{row_id}>, x array<double>, w array<double>").checkpoint()


def _tiles_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray | None, np.ndarray | None]]:
    """(the tile's row, its matrix, what it carries), tile by tile; None of what is null."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            x, w = (None if row.column(c).null_count else row.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("x", "w"))
            yield row, x.reshape(-1, width), w


def farthest(delta: float) -> float:
    """The largest double whose root is at most delta: sqrt(d) <= delta just where d <= farthest(delta)."""
    with np.errstate(over="ignore"):
        out = np.float64(delta) * np.float64(delta)
        while np.sqrt(out) > delta:
            out = np.nextafter(out, 0.0)
        while np.isfinite(following := np.nextafter(out, np.inf)) and np.sqrt(following) <= delta:
            out = following
    return float(out)


class Leaves:
    """A tile's rows in leaves of neighbours, with their boxes, weights and sums."""

    def __init__(self, x: np.ndarray, weights: np.ndarray):
        at = np.arange(0, len(x), LEAF)
        self.x, self.weights = x, weights
        self.low, self.high, self.totals = np.minimum.reduceat(x, at), np.maximum.reduceat(x, at), np.add.reduceat(weights, at)
        self.sums = np.zeros_like(weights)

    def add(self, other: Leaves, limit: float) -> None:
        """Adds to every row's sums the weights of the other's rows within a squared distance."""
        whole = all_within(self.low, self.high, other.low, other.high, limit)
        self.sums += np.repeat(whole.astype(np.float64) @ other.totals, LEAF, axis=0)[: len(self.x)]
        left = ~(whole | none_within(self.low, self.high, other.low, other.high, limit))
        for leaf in np.flatnonzero(left.any(axis=1)):
            rows = slice(leaf * LEAF, (leaf + 1) * LEAF)
            near = (np.flatnonzero(left[leaf])[:, None] * LEAF + np.arange(LEAF)).ravel()
            near = near[: np.searchsorted(near, len(other.x))]
            inside = squared_gaps(self.x[rows], other.x[near]) <= limit
            self.sums[rows] += inside.astype(np.float64) @ other.weights[near]


def around(tiles: DataFrame, delta: float, width: int, weigh: Weigh) -> DataFrame:
    """Tiles with ``sums``: for each row in turn, the weights of all rows within delta of it added up, itself included.

    ``tiles`` is read twice. Of each tile a box and a total go to the driver at once; all
    else is lazy. Tiles are added in their order.
    """
    spark = tiles.sparkSession
    limit = farthest(delta)

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x, w in _tiles_of(batches, width):
            arrays = [_floats(x.min(axis=0)), _floats(x.max(axis=0)), _floats(weigh(x, w).sum(axis=0))]
            yield pa.RecordBatch.from_arrays([row.column("tile"), *arrays], ["tile", "low", "high", "total"])

    boxes = sorted(tiles.mapInArrow(boxed, "tile long, low array<double>, high array<double>, total array<double>").collect())
    names = [box["tile"] for box in boxes]
    low, high, totals = (np.array([box[c] for box in boxes], np.float64) for c in ("low", "high", "total"))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A tile with the totals that it takes as they are, and a copy to each tile that takes it in part."""
        said = ["tile", "source", "ids", "x", "w", "sums"]
        for row, x, _ in _tiles_of(batches, width):
            box = x.min(axis=0)[None], x.max(axis=0)[None], low, high, limit
            whole = all_within(*box)[0]
            own = [row.column("tile"), pa.array([-1], pa.int64()), row.column("ids"), row.column("x"), row.column("w"), _floats(totals[whole].sum(axis=0))]
            yield pa.RecordBatch.from_arrays(own, said)
            nobody = pa.nulls(1, row.column("ids").type)
            for i in np.flatnonzero(~(whole | none_within(*box)[0])):
                yield pa.RecordBatch.from_arrays([pa.array([names[i]], pa.int64()), row.column("tile"), nobody, row.column("x"), row.column("w"), NONE], said)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, own = None, None

        def done() -> pa.RecordBatch:
            base = row.column("sums").flatten().to_numpy(zero_copy_only=False)
            kept = ["tile", "ids", "x", "w"]
            return pa.RecordBatch.from_arrays([*(row.column(c) for c in kept), _floats(own.sums + base)], [*kept, "sums"])

        for other, x, w in _tiles_of(batches, width):
            found = Leaves(x, weigh(x, w))
            if other.column("source")[0].as_py() >= 0:
                own.add(found, limit)
                continue
            if own:
                yield done()
            row, own = other, found
        if own:
            yield done()

    ids = tiles.schema["ids"].dataType.simpleString()
    held = f"ids {ids}, x array<double>, w array<double>, sums array<double>"
    parts = max(1, min(len(names), max(spark.sparkContext.defaultParallelism, len(names) // 8)))
    messages = tiles.mapInArrow(sent, f"tile long, source long, {held}").repartition(parts, "tile").sortWithinPartitions("tile", "source")
    return messages.mapInArrow(met, f"tile long, {held}")


def ones(x: np.ndarray, _) -> np.ndarray:
    """Weights that count rows."""
    return np.ones((len(x), 1))


def by_row(tiles: DataFrame, shown: Callable[[np.ndarray], list[pa.Array]], kinds: str, size: int) -> DataFrame:
    """row_id of every row of tiles, with columns that ``shown`` makes of a matrix of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                yield pa.RecordBatch.from_arrays([batch.column("ids").flatten(), *shown(sums)], names)

    row_id = tiles.schema["ids"].dataType.elementType.simpleString()
    names = ["row_id", *(kind.split()[0] for kind in kinds.split(", "))]
    return tiles.select("ids", "sums").mapInArrow(run, f"row_id {row_id}, {kinds}")


def counts_within(points: Points, delta: float) -> DataFrame:
    """(row_id, n): the rows within delta of every row, itself included."""
    found = around(tiled(points), delta, points.width, ones)
    return by_row(found, lambda sums: [pa.array(sums[:, 0].astype(np.int64))], "n long", 1)


def edge_count(tiles: DataFrame) -> int:
    """The sums of all rows, added up: of degrees the number of edges."""
    total = F.aggregate("sums", F.lit(0.0), lambda a, b: a + b).cast("decimal(38,0)")
    return int(tiles.agg(F.sum(total)).head()[0])

"""Exact top-k inner products with multi-resolution segment bounds.

A vector's components are cut into equal segments, coarse to fine. On a segment of
n components with means m, m' and deviations s, s' the inner product is at most
n (m m' + s s'), so that the sum over segments bounds it from above; in terms of
distance, it bounds the distance from below. Per query, candidates whose bound lies
below the k-th best score so far are dropped level by level; survivors are scored
exactly, in integers. The first k-th best score of a query comes from the exact
scores of a block of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, discard, written

#: Segments at each level.
LEVELS = (4, 16, 32)
#: Rows of a candidate block and queries of a block (about), queries taken at once.
ROWS, QUERIES, STEP = 4096, 32768, 512
#: Candidate blocks that pass a query block in one task at most.
SHARE = 64
#: Above this share of surviving pairs a block's next products are one matrix product.
DENSE = 0.02
#: Relative slack of the bounds for rounding.
SLACK = 1e-9
#: Integer products up to here are exact in doubles.
EXACT = 2.0**53

BLOCK = "block long, width int, ids binary, times binary, data binary, floor binary"


@dataclass
class Matrix:
    """Vectors of one length: ids, how often each row stands in the table (k at most), integers."""

    ids: np.ndarray
    times: np.ndarray
    x: np.ndarray

    def __post_init__(self):
        self.real = self.x.astype(np.float64)
        self.norm = float(np.abs(self.real).max(initial=0.0))
        fill = -self.x.shape[1] % LEVELS[-1]
        padded = np.pad(self.real, ((0, 0), (0, fill))) if fill else self.real
        #: Means and deviations of every segment; zero-filling changes no inner product.
        self.segments = []
        for level in LEVELS:
            parts = padded.reshape(len(padded), level, -1)
            root = np.sqrt(parts.shape[2])
            self.segments.append(np.concatenate([root * parts.mean(axis=2), root * parts.std(axis=2)], axis=1))

    def part(self, some: slice) -> Matrix:
        found = object.__new__(Matrix)
        found.ids, found.times, found.x, found.real, found.norm = self.ids[some], self.times[some], self.x[some], self.real[some], self.norm
        found.segments = [s[some] for s in self.segments]
        return found


def loosened(bound: np.ndarray) -> np.ndarray:
    return bound + SLACK * (1 + np.abs(bound)) + 1e-6


def exact_all(a: Matrix, b: Matrix) -> np.ndarray:
    """All inner products, as integers."""
    if a.norm * b.norm * a.x.shape[1] < EXACT:
        return (a.real @ b.real.T).astype(np.int64)
    return a.x @ b.x.T


class Survivors:
    """Pairs that are left, as a mask while they are many and as a list when they are few."""

    def __init__(self, mask: np.ndarray):
        self.shape, self.mask, self.rows, self.at = mask.shape, mask, None, None
        self.settle()

    def settle(self) -> None:
        if self.mask is not None and np.count_nonzero(self.mask) <= DENSE * self.mask.size:
            (self.rows, self.at), self.mask = np.nonzero(self.mask), None

    def __len__(self) -> int:
        return int(np.count_nonzero(self.mask)) if self.rows is None else len(self.rows)

    def drop_below(self, a: np.ndarray, b: np.ndarray, floor: np.ndarray) -> None:
        """Drops pairs whose bound, a product of rows of a and b, lies below the query's floor."""
        if self.rows is None:
            self.mask &= loosened(a @ b.T) >= floor[:, None]
            self.settle()
        else:
            kept = loosened(np.einsum("ij,ij->i", a[self.rows], b[self.at])) >= floor[self.rows]
            self.rows, self.at = self.rows[kept], self.at[kept]

    def scores(self, queries: Matrix, found: Matrix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, candidate row, exact score)."""
        if self.rows is None:
            every = exact_all(queries, found)
            rows, at = np.nonzero(self.mask)
            return rows, at, every[rows, at]
        return self.rows, self.at, np.einsum("ij,ij->i", queries.x[self.rows], found.x[self.at])


def search(queries: Matrix, found: Matrix, k: int, floor: np.ndarray, left: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best rows, ties to the smaller id.

    A row with the query's own id is no candidate. ``floor`` has, for each query, a
    score that k other candidates reach: rows below it are left out. ``left`` is
    given the pairs left after each level.
    """
    pairs = Survivors(queries.ids[:, None] != found.ids[None, :])
    for a, b in zip(queries.segments, found.segments, strict=True):
        pairs.drop_below(a, b, floor)
        if left is not None:
            left.append(len(pairs))
    rows, at, scores = pairs.scores(queries, found)
    high = scores >= floor[rows]
    rows, at, scores = rows[high], at[high], scores[high]
    times = np.minimum(queries.times[rows] * found.times[at], k)
    return best_k(*(np.repeat(v, times) for v in (rows, found.ids[at], scores)), k)


def best_k(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, in order."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    kept = rank < k
    return rows[kept], ids[kept], scores[kept]


def kth(rows: np.ndarray, scores: np.ndarray, k: int, floor: np.ndarray) -> np.ndarray:
    """The floors, raised to the k-th of the rows that have k scores, in order."""
    counts = np.bincount(rows, minlength=len(floor))
    full = counts == k
    out = floor.copy()
    out[full] = np.maximum(out[full], scores[np.cumsum(counts)[full] - 1])
    return out


class Search:
    """A block of queries that candidate blocks pass one after the other."""

    def __init__(self, queries: Matrix, k: int, floor: np.ndarray | None = None):
        self.queries, self.k = queries, k
        self.floor = np.full(len(queries.ids), -np.inf) if floor is None else floor.copy()
        self.best = [tuple(np.zeros(0, np.int64) for _ in range(3)) for _ in range(0, len(queries.ids), STEP)]

    def meet(self, found: Matrix, left: list[list[int]] | None = None) -> None:
        for i, best in enumerate(self.best):
            some = slice(i * STEP, (i + 1) * STEP)
            count: list[int] = []
            new = search(self.queries.part(some), found, self.k, self.floor[some], count)
            self.best[i] = best_k(*(np.concatenate(v) for v in zip(best, new, strict=True)), self.k)
            self.floor[some] = kth(self.best[i][0], self.best[i][2], self.k, self.floor[some])
            if left is not None:
                left.append(count)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score)"""
        found = [(rows + i * STEP, ids, scores) for i, (rows, ids, scores) in enumerate(self.best)]
        rows, ids, scores = (np.concatenate([np.zeros(0, np.int64), *v]) for v in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
        return self.queries.ids[rows], ids, scores


def unpacked(width: int, ids: bytes, times: bytes, data: bytes) -> Matrix:
    return Matrix(np.frombuffer(ids, "<i8"), np.frombuffer(times, "<i8"), np.frombuffer(data, "<i8").reshape(-1, width))


def whole_vectors(df: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the rows that take part."""
    rows = columns(df, vec_id=id_col, vector=vector_col).where("vec_id is not null")
    rows = rows.withColumn("vector", F.col("vector").cast("array<double>")).where("size(vector) > 0")
    # No comparison with a null or a NaN holds.
    rows = rows.where("forall(vector, c -> c is not null and not isnan(c) and abs(c) <= 1.7976931348623157E308D)")
    return rows.select("vec_id", F.transform("vector", lambda c: F.floor(F.lit(float(scale)) * c).cast("long")).alias("x"))


def top_k(
    df: DataFrame, is_query: str, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", repeats: bool = False
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest inner products.

    Components become floor(scale x). Queries are the rows that satisfy the SQL
    condition ``is_query`` on ``vec_id``; candidates are all rows with another id;
    all, if there are fewer than k. Ties go to the smaller id. Vectors null, empty
    or holding null or a non-finite component, and rows without an id, take no part;
    vectors of another length than a query's are no candidates of it; other columns take
    no part; an empty table gives no row. With ``repeats``, rows that repeat an id all
    take part, and the rows of a query's id share its k places; else of those of one
    length the least vector alone takes part.

    Equal rows are one with a count before anything meets. Rows are dealt to blocks
    by a hash of their id and vector. Blocks of QUERIES queries are held by tasks
    past which candidate blocks stream, each read once for a query block; a task
    sends on k rows a query. What it holds doesn't grow with the input.
    """
    spark = df.sparkSession
    rows = whole_vectors(df, scale, id_col, vector_col)
    if repeats:
        rows = rows.groupBy("vec_id", "x").agg(F.least(F.count("*"), F.lit(k)).cast("long").alias("times"))
    else:
        rows = rows.groupBy("vec_id", F.size("x").alias("width")).agg(F.min("x").alias("x")).select("vec_id", "x", F.lit(1).cast("long").alias("times"))
    rows = written(rows, "vectors")
    chosen = rows.where(is_query)
    n_rows, n_queries = rows.count(), chosen.count()
    cores = spark.sparkContext.defaultParallelism
    # While there are few, blocks of queries are parted so that every core has one.
    blocks, query_blocks = max(1, -(-n_rows // ROWS)), max(1, -(-n_queries // QUERIES), min(cores, -(-n_queries // STEP)))
    together = max(1, 2 * cores // query_blocks)
    shares = min(blocks, max(-(-blocks // SHARE), together))

    def packed(of: DataFrame, n: int, floors=None) -> DataFrame:
        """A row for each block and vector length."""

        def pack(key: tuple, found: pa.Table) -> pa.Table:
            width = key[1].as_py()
            found = found.combine_chunks().sort_by([("vec_id", "ascending")])
            ids, times = (found.column(name).to_numpy().astype("<i8") for name in ("vec_id", "times"))
            data = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in found.column("x").chunks]).astype("<i8")
            floor = np.full(len(ids), -np.inf) if floors is None else floors(unpacked(width, ids.tobytes(), times.tobytes(), data.tobytes()))
            values = [key[0].as_py(), width, ids.tobytes(), times.tobytes(), data.tobytes(), floor.astype("<f8").tobytes()]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.table({c.split()[0]: pa.array([v], t) for c, v, t in zip(BLOCK.split(", "), values, kinds, strict=True)})

        numbered = of.select("*", F.pmod(F.xxhash64("vec_id", "x"), F.lit(n)).alias("block"), F.size("x").alias("width"))
        if n <= 4 * cores:
            # A few heavy groups would be coalesced into one task by their size.
            numbered = numbered.repartition(4 * cores, "block", "width")
        return numbered.groupBy("block", "width").applyInArrow(pack, BLOCK)

    candidates = written(packed(rows, blocks), "candidates")
    # One block of candidates, a sample by hash, comes to the driver: about ROWS vectors.
    sample = [unpacked(r["width"], *(bytes(r[c]) for c in ("ids", "times", "data"))) for r in candidates.where("block = 0").collect()]

    def floors(queries: Matrix) -> np.ndarray:
        run = Search(queries, k)
        for found in sample:
            if found.x.shape[1] == queries.x.shape[1]:
                run.meet(found)
        return run.floor

    queries = written(packed(chosen, query_blocks, floors), "queries")
    discard(rows)
    every = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<long>")).alias("query")
    right = candidates.select(F.lit(1).alias("side"), "*", F.pmod("block", F.lit(shares)).alias("share"), every)
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<long>")).alias("share")
    left = queries.select(F.lit(0).alias("side"), "*", every, F.col("block").alias("query"))
    both = left.unionByName(right).withColumn("slot", (F.col("query") * shares + F.col("share")).cast("int"))
    dealt = both.repartitionById(query_blocks * shares, F.col("slot")).sortWithinPartitions("slot", "width", "side", "block")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by slot and length, the queries before the candidates."""
        key, run = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in run.result()], ["query_id", "vec_id", "score"])

        for batch in batches:
            for slot, width, side, *found, floor in zip(*(batch.column(c) for c in ("slot", "width", "side", "ids", "times", "data", "floor")), strict=True):
                now = (slot.as_py(), width.as_py())
                if now != key:
                    if run is not None:
                        yield done()
                    key, run = now, None
                if side.as_py() == 0:
                    run = Search(unpacked(now[1], *(v.as_py() for v in found)), k, np.frombuffer(floor.as_py(), "<f8"))
                elif run is not None:
                    run.meet(unpacked(now[1], *(v.as_py() for v in found)))
        if run is not None:
            yield done()

    found = dealt.select("slot", "width", "side", "ids", "times", "data", "floor").mapInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

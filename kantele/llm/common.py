"""Helpers shared by the operators: Arrow batches, word splitting, shared tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Bytes of text that one step inside a task handles at once.
SLICE_BYTES = 8 << 20

#: Types of the operators' own columns.
KINDS = {"doc_id": "long", "page_id": "long", "vec_id": "long", "text": "string", "html": "string", "url": "string"}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back; cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


def discard(df: DataFrame) -> None:
    """Removes a table of ``written`` that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names and types.

    Any other column, whatever it is called, takes no part.
    """
    return df.select(*(F.col(f"`{of}`").cast(KINDS[to]).alias(to) if to in KINDS else F.col(f"`{of}`").alias(to) for to, of in names.items()))


def sliced(batch: pa.RecordBatch, text: str | int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about ``most`` bytes of text; a longer row stands alone."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_text(
    df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text", most: int = SLICE_BYTES
) -> DataFrame:
    """``step`` over slices of every batch, of about ``most`` bytes of text, in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, text, most):
                yield step(part)

    return df.mapInArrow(run, schema)


def keep(df: DataFrame, verdict: Callable[[pa.Array], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows whose text the verdict keeps, with all their columns; one narrow pass."""
    position = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, position):
                yield part.filter(pa.array(verdict(part.column(position)), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def texts(column: pa.Array) -> pa.Array:
    """The column as strings, null as the empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


@dataclass
class Words:
    """Words of consecutive texts: codes[offsets[i]:offsets[i + 1]] into dictionary."""

    offsets: np.ndarray
    codes: np.ndarray
    dictionary: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def rows(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum over each text's words of values, given for each word."""
        total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def encoded(lists: pa.ListArray, drop_empty: bool) -> Words:
    """Dictionary-encoded values of a list array, without empty strings if asked."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    if drop_empty:
        full = pc.not_equal(values, "")
        if pc.all(full).as_py() is False:
            kept = full.to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
            values = values.filter(full)
    found = values.dictionary_encode()
    return Words(offsets, found.indices.to_numpy(zero_copy_only=False), found.dictionary)


def words(column: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text; null has none."""
    return encoded(pc.ascii_split_whitespace(texts(column)), drop_empty=True)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)

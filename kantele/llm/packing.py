"""Packing of token sequences with a bounded number of open windows.

Each partition keeps a fixed number of open windows. A document goes where it fits
best; where it fits nowhere, the fullest window is topped up with the document's
first ids and emitted. What is left open at the end of a partition meets the
leftovers of neighbouring partitions in rounds of bounded groups.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import opened
from .common import columns, sliced, written

WINDOW = 2048
#: Open windows of a partition.
OPEN = 32
#: Partitions whose leftovers meet in one group.
GROUP = 64
#: The fullest window is topped up if it lacks at least so many ids.
TOP_UP = 16
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in PIECE.split(", ")]


class Windows:
    """Open windows by free room; a full or emitted window gets the next number."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.free: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.made = 0

    def best(self, need: int) -> int | None:
        at = bisect_left(self.free, (need, -1))
        return at if at < len(self.free) else None

    def put(self, at: int | None, piece: tuple, length: int) -> list | None:
        """Adds a piece to a window, or to a new one; the window if that fills it."""
        room, key = self.free.pop(at) if at is not None else (self.size, self.made)
        self.made += at is None
        self.held.setdefault(key, []).append((piece, self.size - room))
        if room == length:
            return self.held.pop(key)
        insort(self.free, (room - length, key))
        return None

    def pop_fullest(self) -> list:
        return self.held.pop(self.free.pop(0)[1])

    def rest(self) -> list[list]:
        """Open windows, the emptiest last."""
        return [self.held[key] for _, key in self.free]


def packed(lengths, size: int = WINDOW, most: int = OPEN, top_up: int = TOP_UP):
    """Packs documents of the given lengths one by one.

    Yields (window, done) with window a list of ((document, start, length), offset);
    done is False for the windows still open at the end.
    """
    windows = Windows(size, most)
    for document, length in enumerate(lengths):
        start = 0
        while length - start > size:
            yield [((document, start, size), 0)], True
            start += size
        while start < length:
            need = length - start
            at = windows.best(need)
            if at is None and len(windows.free) >= most:
                room = windows.free[0][0]
                if room < top_up:
                    yield windows.pop_fullest(), True
                    continue
                at, need = 0, room
            if full := windows.put(at, (document, start, need), need):
                yield full, True
            start += need
    for window in windows.rest():
        yield window, False


def merged(lengths, size: int = WINDOW, most: int = OPEN):
    """Packs leftover pieces without cutting them, the longest first.

    Yields (window, done) as packed() does; at most ``most`` windows, the emptiest,
    stay open.
    """
    windows = Windows(size, len(lengths))
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if full := windows.put(windows.best(lengths[piece]), (piece, 0, lengths[piece]), lengths[piece]):
            yield full, True
    rest = windows.rest()
    for i, window in enumerate(rest):
        yield window, i < len(rest) - most


def padded(length: int, window: int = WINDOW) -> int:
    """Ids of a sequence with its padding: up to the window, none where its length is a power of two."""
    return length if length & (length - 1) == 0 else window


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    window: int = WINDOW,
    open_windows: int = OPEN,
    group: int = GROUP,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of a document in a sequence of at most ``window`` ids.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone.
    Pieces of a sequence lie one after another from offset 0. Ids, a null one too,
    and repeated rows are kept as they are; other columns take no part; an empty
    table gives no piece. ``with_ids`` adds the piece's ids as little-endian
    unsigned 32-bit binary.

    The first pass is narrow. The leftovers, at most ``open_windows`` windows a
    partition, are merged in rounds of ``group`` partitions; a group's size doesn't
    grow with the input.
    """
    schema = PIECE + ", open int, part long" + (", ids binary" if with_ids else "")

    def table(rows: list[tuple]) -> pa.RecordBatch:
        fields = [pa.field(n, pa.binary() if n == "ids" else pa.int32() if n == "open" else pa.int64()) for n in (x.split()[0] for x in schema.split(", "))]
        found = list(zip(*rows, strict=True)) or [[]] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, fields, strict=True)], schema=pa.schema(fields))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = opened(tokenizer), TaskContext.get().partitionId()
        tail = np.array([end_id], "<u4").tobytes()
        known: dict[int, tuple] = {}

        def lengths():
            number = 0
            for batch in batches:
                for piece in sliced(batch, "text"):
                    ids, ends = encoder.encode(piece.column("text"))
                    ids = ids.astype("<u4")
                    for i, doc in enumerate(piece.column("doc_id").to_pylist()):
                        data = ids[ends[i] : ends[i + 1]].tobytes() + tail
                        known[number] = (doc, data)
                        yield len(data) // 4
                        number += 1

        rows: list[tuple] = []
        made, last = 0, -1
        for found, done in packed(lengths(), window, open_windows):
            made += 1
            number = (part + 1) << 32 | made
            for (document, start, length), offset in found:
                doc, data = known[document]
                ids = data[4 * start : 4 * (start + length)]
                row = (doc, start, length, zlib.crc32(ids), len(data) // 4, number, offset, int(not done), part)
                rows.append((*row, ids) if with_ids else row)
                if start + length == len(data) // 4:
                    del known[document]
            if len(rows) >= 5000:
                yield table(rows)
                rows = []
        if rows:
            yield table(rows)

    def again(level: int):
        def merge(key: tuple, found: pa.Table) -> pa.Table:
            """Leftovers of one group; the order of its rows plays no part."""
            rows = sorted(zip(*(found.column(i).to_pylist() for i in range(found.num_columns)), strict=True), key=lambda r: (r[5], r[6]))
            number = key[0].as_py()
            out = []
            for made, (held, done) in enumerate(merged([r[2] for r in rows], window, open_windows)):
                for (piece, _, _), offset in held:
                    r = rows[piece]
                    out.append((*r[:5], level << 58 | number << 28 | made, offset, int(not done), number, *r[9:]))
            return pa.Table.from_batches([table(out)])

        return merge

    docs = columns(df, doc_id=id_col, text=text_col)
    names = NAMES + (["ids"] if with_ids else [])
    found = written(docs.mapInArrow(first, schema), "packing")
    parts = docs.rdd.getNumPartitions()
    closed = [found.where("open = 0")]
    level = 1
    while True:
        groups = -(-parts // group)
        rest = found.where("open = 1").withColumn("part", F.col("part").cast("long") / group)
        rest = rest.withColumn("part", F.floor("part").cast("long"))
        found = rest.groupBy("part").applyInArrow(again(level), schema)
        if groups <= 1:
            closed.append(found)
            break
        found = written(found, "packing")
        closed.append(found.where("open = 0"))
        parts, level = groups, level + 1
    out = closed[0].select(names)
    for more in closed[1:]:
        out = out.unionByName(more.select(names))
    return out

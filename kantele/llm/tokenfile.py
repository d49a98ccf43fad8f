"""Token ids in compressed block files with a shared dictionary.

A store is a folder of two Parquet tables. ``dictionary`` has one row: the
zstandard dictionary trained on serialized id arrays, and its hash. ``blocks`` has
one row for each block, whose ``data`` is a complete file image:

    magic "KTK1", id width (1 byte), 3 zero bytes, dictionary hash (8 bytes),
    ids before the block in its partition (8), number of documents n (8),
    doc_id (n x 8), doc_id is null (n x 1), ids of each document (n x 8),
    end of each frame (n x 8), then the frames, one for each document.

All numbers are little-endian. A document is read by its index entry alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import opened
from .common import columns, discard, map_text, shared_folder, sliced, written

MAGIC = b"KTK1"
HEAD = struct.Struct("<4sB3x8sqq")
#: Documents on which the dictionary is trained at most, and ids of a window of each.
SAMPLE, SAMPLE_IDS = 1000, 4096
DICTIONARY_BYTES = 64 << 10
#: A block is closed at so many bytes of frames or documents.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 8192
#: Ids that a partition of the store holds (about), beyond the configured partitions.
PART_IDS = 32 << 20
LEVEL = 3


def dictionary_hash(dictionary: bytes) -> bytes:
    return xxhash.xxh64_digest(dictionary)


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; of too few samples, their plain content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _shared(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=_shared(dictionary), write_checksum=False)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=_shared(dictionary))


def block(doc_ids: list[int | None], counts: list[int], frames: list[bytes], before: int, width: int, digest: bytes) -> bytes:
    """The file image of one block."""
    return b"".join(
        [
            HEAD.pack(MAGIC, width, digest, before, len(doc_ids)),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], "u1").tobytes(),
            np.array(counts, "<i8").tobytes(),
            np.cumsum(np.array([len(x) for x in frames], "<i8"), dtype="<i8").tobytes(),
            *frames,
        ]
    )


class Block:
    """A block's index; documents are decompressed one at a time."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, width, digest, self.before, n = HEAD.unpack_from(data)
        if magic != MAGIC or digest != dictionary_hash(dictionary):
            raise ValueError("not a block of this dictionary")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.nulls = np.frombuffer(data, "u1", n, at + 8 * n).astype(bool)
        self.counts = np.frombuffer(data, "<i8", n, at + 9 * n)
        self.ends = np.frombuffer(data, "<i8", n, at + 17 * n)
        self.data, self.frames = memoryview(data), at + 25 * n
        self.kind = np.dtype(f"<u{width}")
        self.read = decompressor(dictionary)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, at: int) -> np.ndarray:
        start = self.frames + (int(self.ends[at - 1]) if at else 0)
        size = max(1, int(self.counts[at]) * self.kind.itemsize)
        return np.frombuffer(self.read.decompress(self.data[start : self.frames + int(self.ends[at])], max_output_size=size), self.kind)


@dataclass
class TokenStore:
    """A written store."""

    spark: SparkSession
    path: str

    def dictionary(self) -> bytes:
        return bytes(self.spark.read.parquet(f"{self.path}/dictionary").head()["dictionary"])

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def bases(self) -> dict[int, int]:
        """Ids before each partition: one number for each partition that wrote."""
        total, out = 0, {}
        for part, tokens in sorted(self.blocks().groupBy("part").agg(F.sum("n_tokens")).collect()):
            out[part] = total
            total += tokens
        return out

    def documents(self, with_ids: bool = False) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, read from the blocks.

        ``start`` counts the ids of all documents before it in the order of doc_id;
        null ids come first, equal ones in the order of their contents.
        """
        dictionary, bases = self.dictionary(), self.bases()
        schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                    found = Block(data.as_py(), dictionary)
                    starts = bases[part] + found.before + np.cumsum(found.counts) - found.counts
                    ids = [found.ids(i).astype("<u4") for i in range(len(found))]
                    arrays = [
                        pa.array(found.doc_ids, pa.int64(), mask=found.nulls),
                        pa.array(starts, pa.int64()),
                        pa.array(found.counts, pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    ]
                    if with_ids:
                        arrays.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

        return self.blocks().select("part", "data").mapInArrow(read, schema)

    def document(self, doc_id: int) -> list[np.ndarray]:
        """Ids of all documents with this id, none if there are none: only blocks that can hold it are read.

        Rows without an id are not found by one; an empty text has the end id alone.
        """
        dictionary, out = self.dictionary(), []
        for row in self.blocks().where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("data").toLocalIterator():
            found = Block(bytes(row["data"]), dictionary)
            out += [found.ids(i) for i in np.flatnonzero((found.doc_ids == doc_id) & ~found.nulls)]
        return out


def write_store(
    df: DataFrame,
    tokenizer: str,
    path: str | None = None,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> TokenStore:
    """Encodes every document, ``end_id`` last, and writes a store in the order of doc_id.

    Null and empty texts hold ``end_id`` alone; null ids and repeated rows are kept,
    in the order of their lengths and contents; other columns take no part; an empty
    table gives a store without blocks.

    The ids are made once, compressed where they are made, and only the frames are
    shuffled, by range of doc_id; rows that share an id go on to the next partition
    like others. The dictionary is trained on a sample: the SAMPLE different rows with
    the least hashes of id and text, encoded whole; of longer ones a window of
    SAMPLE_IDS ids, which lies where the hash says.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    docs = columns(df, doc_id=id_col, text=text_col)
    width = opened(tokenizer).kind.itemsize

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends = opened(tokenizer).encode(batch.column("text"))
        out = []
        for a, b, mark in zip(ends[:-1].tolist(), ends[1:].tolist(), batch.column("mark").to_pylist(), strict=True):
            whole = np.append(ids[a:b], np.array([end_id], ids.dtype))
            start = mark % (max(0, len(whole) - SAMPLE_IDS) + 1)
            out.append(whole[start : start + SAMPLE_IDS].tobytes())
        return pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(out, pa.binary())], ["mark", "ids"])

    # Only rows in a share of all hashes are candidates, some four times SAMPLE.
    marked = docs.select("text", F.xxhash64("doc_id", "text").alias("mark")).where(F.pmod("mark", F.lit(max(1, docs.count() // (4 * SAMPLE)))) == 0)
    least = marked.select("mark").distinct().orderBy("mark").limit(SAMPLE)
    chosen = marked.join(F.broadcast(least), "mark", "left_semi").groupBy("mark").agg(F.first("text").alias("text"))
    samples = [bytes(r["ids"]) for r in sorted(map_text(chosen, windows, "mark long, ids binary").collect())]
    dictionary = train(samples)
    digest = dictionary_hash(dictionary)
    spark.createDataFrame([(digest, dictionary)], "hash binary, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, to = opened(tokenizer), compressor(dictionary)
        tail = np.array([end_id], encoder.kind).tobytes()
        made = 0
        for batch in batches:
            for part in sliced(batch, "text"):
                ids, ends = encoder.encode(part.column("text"))
                frames = [to.compress(ids[a:b].tobytes() + tail) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                arrays = [part.column("doc_id"), pa.array(np.diff(ends) + 1, pa.int64()), pa.array(frames, pa.binary()), pa.array(np.arange(made, made + len(frames)) % 4096, pa.int32())]
                made += len(frames)
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "frame", "tie"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, made = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc_ids, counts, frames = map(list, zip(*held, strict=True))
            known = [x for x in doc_ids if x is not None]
            data = block(doc_ids, counts, frames, before, width, digest)
            row = [[part], [made], [len(held)], [sum(counts)], [min(known, default=None)], [max(known, default=None)], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["part", "block", "n_docs", "n_tokens", "first_id", "last_id", "data"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append(row)
                size += len(row[2])
                if size >= BLOCK_BYTES or len(held) >= BLOCK_DOCS:
                    yield flush()
                    before, made, size = before + sum(x[1] for x in held), made + 1, 0
                    held = []
        if held:
            yield flush()

    frames = written(docs.mapInArrow(compress, "doc_id long, n_tokens long, frame binary, tie int"), "frames")
    total = frames.agg(F.sum("n_tokens")).head()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_IDS))
    # Ties of an id are parted by length and content, and equal rows by their number in the table.
    keys = ["doc_id", "n_tokens", F.xxhash64("frame"), "tie"]
    ordered = frames.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("tie")
    ordered.mapInArrow(blocks, "part int, block int, n_docs long, n_tokens long, first_id long, last_id long, data binary").write.parquet(f"{path}/blocks")
    discard(frames)
    return TokenStore(spark, path)

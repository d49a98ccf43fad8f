"""Language-model scoring by cross-entropy difference.

A target and a background model of the same form share one vocabulary: the distinct
words of both corpora, and one word that stands for any other. Counts of words, and of pairs of them, are exact and come from
all rows of both corpora; the background's are scaled to the target's size, as if it
were a sample of that size, so that both smooth alike. A document's score is the mean
difference of its per-token losses: the lower, the closer to the target.

The counts grow with the corpus, so no process holds them all. Documents are cut into
chunks of text; the distinct words and pairs of a chunk ("keys", a pair as the two
words with a space between, which no word holds) are dealt by a hash to groups, each
group adds up its keys over all chunks, and every chunk gets back the counts of its
own keys. The hash says only where a key is counted: keys are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, columns, sliced, texts, words, written

#: Bits of the hash that deals keys to groups; smoothing of words and of pairs.
HASH_BITS, ALPHA, BETA = 22, 0.05, 4.0
#: Groups of keys at least; bytes of text whose keys a group holds (about), beyond that.
GROUP, GROUP_BYTES = 1024, 8 << 20
#: Bytes of text whose keys, or chunks, a task reads (about).
TASK_BYTES = 256 << 20
#: Sides of a chunk's keys; the group that stands for its documents.
TARGET, BACKGROUND, ASKED = range(3)
DOCUMENTS = -1


def classes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of every word among the distinct ones, offsets of the texts); A-Z count as a-z."""
    found = words(pc.ascii_lower(texts(column)))
    return found.codes.astype(np.int64), found.offsets


def pairs(of: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each pair, index of its second word)."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    second = np.flatnonzero(rows[1:] == rows[:-1]) + 1
    return of[second - 1] * (int(of.max(initial=0)) + 1) + of[second], second


class Keys:
    """Distinct words of consecutive texts, then distinct pairs, and where texts have them."""

    def __init__(self, column: pa.Array, groups: int):
        found = words(pc.ascii_lower(texts(column)))
        self.of, self.offsets = found.codes.astype(np.int64), found.offsets
        self.words = found.dictionary.cast(pa.large_binary())
        number, self.at = pairs(self.of, self.offsets)
        distinct, self.pair, counts = np.unique(number, return_inverse=True, return_counts=True)
        self.first, self.second = np.divmod(distinct, int(self.of.max(initial=0)) + 1)
        self.counts = np.concatenate([np.bincount(self.of, minlength=len(self.words)), counts])
        digest = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words.to_pylist()), np.uint64, len(self.words))
        mixed = np.concatenate([digest, digest[self.first] * np.uint64(31) + digest[self.second]]) * np.uint64(0x9E3779B97F4A7C15)
        group = (mixed >> np.uint64(64 - HASH_BITS)).astype(np.int64) % groups
        self.order = np.argsort(group, kind="stable")
        self.ends = np.cumsum(np.bincount(group, minlength=groups))

    def packed(self) -> Iterator[tuple[int, bytes]]:
        """(group, its keys and their counts), groups in order."""
        joined = pc.binary_join_element_wise(self.words.take(pa.array(self.first)), self.words.take(pa.array(self.second)), pa.scalar(b" ", pa.large_binary()))
        keys = pa.concat_arrays([self.words, joined]).take(pa.array(self.order))
        offsets = np.frombuffer(keys.buffers()[1], "<i8", len(keys) + 1) if len(keys) else np.zeros(1, np.int64)
        lengths, counts, data = np.diff(offsets).astype("<u4"), self.counts[self.order].astype("<u4"), keys.buffers()[2]
        to = zstandard.ZstdCompressor()
        start = 0
        for group, end in enumerate(self.ends.tolist()):
            if end > start:
                parts = [np.array([end - start], "<i8"), lengths[start:end], counts[start:end], memoryview(data)[offsets[start] : offsets[end]]]
                yield group, to.compress(b"".join(parts))
            start = end

    def placed(self, found: np.ndarray) -> np.ndarray:
        """Values in the order of packed() as values of words, then of pairs."""
        out = np.empty_like(found)
        out[..., self.order] = found
        return out


def unpacked(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """(keys, counts) of a group of one chunk."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    lengths, counts = (np.frombuffer(raw, "<u4", n, at).astype(np.int64) for at in (8, 8 + 4 * n))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw[8 + 8 * n :])]), counts


def chunks(docs: DataFrame, name: str) -> DataFrame:
    """(chunk, size, data): documents of about SLICE_BYTES of text a row, written once so that chunks stay as they are."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            for part in sliced(batch, "text"):
                new = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if held and size + new > SLICE_BYTES:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, size = [], 0
                held.append(part)
                size += new
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, part in enumerate(joined(batches)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_table(part)
            data = zstandard.ZstdCompressor().compress(sink.getvalue())
            yield pa.RecordBatch.from_pydict({"chunk": [task << 32 | i], "size": [part.nbytes], "data": [data]})

    return written(docs.mapInArrow(run, "chunk long, size long, data binary"), name)


def documents(data: bytes) -> pa.Table:
    """The documents of a chunk."""
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all().combine_chunks()


def keyed(found: DataFrame, groups: int) -> DataFrame:
    """(chunk, group, data): the keys of every chunk and their counts, by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                rows = list(Keys(documents(data.as_py()).column("text"), groups).packed())
                arrays = [pa.array([chunk] * len(rows), pa.int64()), pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["chunk", "group", "data"])

    return found.select("chunk", "data").mapInArrow(run, "chunk long, group int, data binary")


@dataclass
class Difference:
    """The matched models: the chunks of both corpora, whose keys are counted when documents are scored.

    ``fitted`` is the background with the names of its id and text; scoring the same
    DataFrame takes the background's chunks. ``parts`` tasks read their keys.
    """

    target: DataFrame
    background: DataFrame
    groups: int
    parts: int
    fitted: tuple[DataFrame, str, str]

    @classmethod
    def fit(
        cls, target: DataFrame, background: DataFrame, target_col: str = "text", background_col: str = "text", id_col: str = "doc_id"
    ) -> Difference:
        ids = {"doc_id": id_col} if id_col in background.columns else {}
        a = chunks(columns(target, text=target_col), "target")
        b = chunks(columns(background, **ids, text=background_col), "background")
        size = sum(x.agg(F.sum("size")).head()[0] or 0 for x in (a, b))
        parts = max(int(background.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
        return cls(a, b, max(GROUP, -(-size // GROUP_BYTES)), parts, (background, id_col, background_col))


RESULT = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def totals(model: Difference, asked: DataFrame | None) -> DataFrame:
    """(chunk, group, data): counts in both corpora of the keys of every chunk asked, or of the background's.

    A row without a chunk for each group has its distinct words and the words of both corpora.
    """
    sides = [(TARGET, model.target), (BACKGROUND, model.background)] + ([(ASKED, asked)] if asked is not None else [])
    answered = BACKGROUND if asked is None else ASKED

    def total(key: tuple, found: pa.Table) -> pa.Table:
        side, chunk = (found.column(x).to_numpy() for x in ("side", "chunk"))
        parts = [unpacked(x.as_py()) for x in found.column("data")]
        ends = np.cumsum([len(x) for x, _ in parts])
        of = pa.concat_arrays([x for x, _ in parts]).dictionary_encode()
        codes, counts = of.indices.to_numpy(), np.concatenate([x for _, x in parts])
        sides = np.repeat(side, np.diff(ends, prepend=0))
        both = np.stack([np.bincount(codes, counts * (sides == x), len(of.dictionary)) for x in (TARGET, BACKGROUND)]).astype("<i8")
        word = ~pc.match_substring(of.dictionary, b" ").to_numpy(zero_copy_only=False) & both.any(axis=0)
        to = zstandard.ZstdCompressor(level=1)
        rows = [(None, None, int(word.sum()), *both[:, word].sum(axis=1).tolist())]
        for i in np.flatnonzero(side == answered).tolist():
            mine = codes[ends[i] - len(parts[i][1]) : ends[i]]
            rows.append((int(chunk[i]), to.compress(both[:, mine].tobytes()), 0, 0, 0))
        kinds = {"chunk": pa.int64(), "data": pa.binary(), "words": pa.int64(), "target": pa.int64(), "background": pa.int64()}
        out = {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds.items())}
        return pa.table(out | {"group": pa.array([key[0].as_py()] * len(rows), pa.int32())})

    every = None
    for side, of in sides:
        some = keyed(of, model.groups).withColumn("side", F.lit(side))
        every = some if every is None else every.unionByName(some)
    return every.repartition(model.parts, "group").groupBy("group").applyInArrow(total, "chunk long, data binary, words long, target long, background long, group int")


def score_documents(df: DataFrame, model: Difference, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row.

    Losses are means over the words ``[^\\x20\\x09-\\x0D]+`` in nats; score is
    target_loss - background_loss, 0 for a text without words, a null one too. Null
    ids and repeated rows are kept; other columns take no part; an empty table gives
    no row. The vocabulary is that of both corpora and one word for all not seen. Keys
    are shuffled by group, and their counts back to the chunks, to as many tasks as
    the corpora's size asks for.
    """
    same = model.fitted[0] is df and model.fitted[1:] == (id_col, text_col)
    asked = None if same else chunks(columns(df, doc_id=id_col, text=text_col), "asked")
    counted = written(totals(model, asked), "totals")
    n_words, *sizes = (x or 0 for x in counted.agg(F.sum("words"), F.sum("target"), F.sum("background")).head())
    scales = (1.0, sizes[0] / sizes[1] if sizes[1] else 1.0)
    vocabulary, groups = n_words + 1, model.groups

    def score(found: pa.Table) -> pa.Table:
        rows = sorted(zip(found.column("group").to_pylist(), found.column("data").to_pylist(), strict=True))
        docs, raw = documents(rows[0][1]), zstandard.ZstdDecompressor()
        keys = Keys(docs.column("text"), groups)
        parts = [np.frombuffer(raw.decompress(x), "<i8").reshape(2, -1) for _, x in rows[1:]]
        counts = keys.placed(np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64))
        n, size = np.diff(keys.offsets), len(keys.words)
        means = []
        for of, total, scale in zip(counts * np.array(scales)[:, None], sizes, scales, strict=True):
            single = (of[:size] + ALPHA) / (total * scale + ALPHA * vocabulary)
            pair = (of[size:] + BETA * single[keys.second]) / (of[:size][keys.first] + BETA)
            losses = -np.log(single)[keys.of]
            losses[keys.at] = -np.log(pair)[keys.pair]
            ends = np.concatenate([[0.0], np.cumsum(losses)])[keys.offsets]
            means.append(np.diff(ends) / np.maximum(n, 1))
        arrays = [docs.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x) for x in means), pa.array(means[0] - means[1])]
        return pa.table(arrays, names=NAMES)

    kept = (model.background if same else asked).select("chunk", F.lit(DOCUMENTS).alias("group"), "data")
    rows = kept.unionByName(counted.where("chunk is not null").select("chunk", "group", "data"))
    return rows.repartition(model.parts, "chunk").groupBy("chunk").applyInArrow(score, RESULT)

"""SentencePiece byte-pair models: encoding with byte offsets, and decoding.

Normalisation replaces, at each place, the longest key of the model's compiled
character map that begins there, and records for every normalised byte the source
byte it came from. Pieces are found on the normalised text and projected through
that record to spans of the original UTF-8 bytes.

Pieces never hold a space mark after another character, so a text falls into chunks
before its space marks, each encoded apart. A batch's distinct chunks are encoded
once.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Words, columns, encoded, map_text, ranges, texts
from .spm_model import BYTE, CONTROL, NORMAL, SPACE, UNKNOWN, SpmModel

#: Chunks that a worker's memo holds, give or take one batch.
MEMO = 300_000
#: Bytes of text handled at once: about 30 arrays of a number for each piece live together.
SLICE = 3 << 20
MARK = SPACE.encode()


class CharacterMap:
    """Compiled character map: a double-array trie of keys, and their replacements.

    The layout is a fixed format: a 32-bit size, the trie's 32-bit units, then
    replacements that end with a zero byte. A unit holds a label (low byte and top
    bit), whether a value follows (bit 8) and the offset to its children.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest key at a place."""
        units, found, node = self.units, None, 0
        node ^= self._offset(units[0])
        for i in range(at, len(data)):
            if data[i] == 0:
                break
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                stop = self.replacements.index(b"\0", start)
                found = i + 1 - at, self.replacements[start:stop]
        return found

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, source offset of each of them and of the end)."""
        if not self:
            return data, np.arange(len(data) + 1)
        out, source, at = bytearray(), [], 0
        while at < len(data):
            hit = self.longest(data, at) if self else None
            if hit is None:
                lead = data[at]
                length = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = length, data[at : at + length]
            length, text = hit
            out += text
            source += [at] * len(text)
            at += length
        return bytes(out), np.array([*source, len(data)], np.int64)


class SentencePieces:
    """Encoder and decoder of one byte-pair model file; pickles as its path."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        model = self.model = SpmModel.read(path)
        self.map = CharacterMap(model.charsmap)
        if model.algorithm != 2 or not model.byte_fallback or model.strip_spaces or not model.mark_spaces:
            raise ValueError(f"{path} is not a byte-pair model with byte fallback that keeps white space")
        if set(model.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} has user-defined or unused pieces")
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == BYTE}
        pieces = {p.encode(): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}", p.decode()) for p in pieces):
            raise ValueError(f"{path} has pieces across spaces")
        # Ranks of the merge engine: bytes, beginnings of characters, then pieces by score.
        ranks = {bytes([b]): b for b in range(256)}
        singles = [x for x in pieces if len(x.decode()) == 1]
        for length in (2, 3, 4):
            for x in singles:
                if len(x) >= length:
                    ranks.setdefault(x[:length], len(ranks))
        for x in sorted(pieces, key=lambda x: (-model.scores[pieces[x]], pieces[x])):
            ranks.setdefault(x, len(ranks))
        self.raw = {rank: x for x, rank in ranks.items()}
        self.of = {rank: pieces[x] for x, rank in ranks.items() if x in pieces}
        self.engine = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.shown = [p.encode() if k == NORMAL else bytes([int(p[3:5], 16)]) if k == BYTE else b"" for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.kind = np.uint16 if len(model.pieces) <= 1 << 16 else np.uint32

    def __reduce__(self):
        return (opened, (self.path,))

    def pieces(self, data: bytes) -> tuple[list[int], list[int]]:
        """(ids, end of each piece in data) of one normalised chunk."""
        ids, ends, at = [], [], 0
        for rank in self.engine._encode_single_piece(data):
            raw = self.raw[rank]
            if (known := self.of.get(rank)) is not None:
                at += len(raw)
                ids.append(known)
                ends.append(at)
            else:
                for byte in raw:
                    at += 1
                    ids.append(self.byte[byte])
                    ends.append(at)
        return ids, ends

    def decode(self, ids) -> str:
        """The text of ids: the library's decode, byte pieces that form no character as U+FFFD."""
        return self.decoded(np.asarray(ids, np.int64))

    def decoded(self, ids: np.ndarray) -> str:
        parts, first, run = [], True, bytearray()
        kinds, shown = self.model.kinds, self.shown
        for i in ids.tolist():
            if kinds[i] == BYTE:
                run += shown[i]
                first = False
                continue
            if run:
                parts.append(_utf8(bytes(run)))
                run.clear()
            if kinds[i] == CONTROL:
                continue
            text = self.model.unknown_surface if kinds[i] == UNKNOWN else shown[i].decode()
            if first and kinds[i] == NORMAL and self.model.dummy_prefix and text.startswith(SPACE):
                text = text[1:]
                first = False
            first = first and not text
            parts.append(text.replace(SPACE, " ") if kinds[i] == NORMAL else text)
        if run:
            parts.append(_utf8(bytes(run)))
        return "".join(parts)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, end) of one text; begin and end are offsets in its UTF-8 bytes."""
        found = Encoded(self, pa.array([text]))
        return found.ids, found.begins, found.ends


def _utf8(data: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that begins no character."""
    out, at = [], 0
    while at < len(data):
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            out.append(data[at : at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


_OPEN: dict[str, SentencePieces] = {}


def opened(path: str) -> SentencePieces:
    """The model of a file, one in each process."""
    if path not in _OPEN:
        _OPEN[path] = SentencePieces(path)
    return _OPEN[path]


class Encoded:
    """Pieces of a batch of texts.

    ``words`` holds the chunks; ``counts`` the pieces of each distinct chunk, whose
    ids and normalised ends are flat[first[i]:first[i] + counts[i]].
    """

    def __init__(self, pieces: SentencePieces, column: pa.Array):
        self.of = pieces
        self.column = texts(column)
        self.sources: list[np.ndarray] | None = None
        normal = self.column
        if pieces.map or pc.any(pc.match_substring(normal, SPACE)).as_py():
            done = [pieces.map.normalise(x.encode()) for x in self.column.to_pylist()]
            normal = pa.array([data.decode() for data, _ in done], pa.string())
            self.sources = [source for _, source in done]
        self.words = self.chunks(normal, pieces.model.dummy_prefix)
        memo = pieces.memo
        if len(memo) > MEMO:
            memo.clear()
        ids, ends = [], []
        for text in self.words.dictionary.to_pylist():
            found = memo.get(text)
            if found is None:
                found = pieces.pieces(text.replace(" ", SPACE).encode())
                found = np.array(found[0], pieces.kind).tobytes(), np.array(found[1], np.uint32).tobytes()
                if len(text) <= 64:
                    memo[text] = found
            ids.append(found[0])
            ends.append(found[1])
        self.counts = np.fromiter(map(len, ends), np.int64, len(ends)) // 4
        self.first = np.cumsum(self.counts) - self.counts
        self.flat_ids = np.frombuffer(b"".join(ids), pieces.kind)
        self.flat_ends = np.frombuffer(b"".join(ends), np.uint32)
        each = self.counts[self.words.codes]
        #: Pieces of text i: ids[offsets[i]:offsets[i + 1]].
        self.offsets = np.concatenate([[0], np.cumsum(each)])[self.words.offsets]

    @staticmethod
    def chunks(column: pa.Array, prefix: bool) -> Words:
        """Chunks that begin with spaces; a text's first has the dummy prefix, an empty text none."""
        if pc.any(pc.match_substring_regex(column, f"^ |  |{SPACE}")).as_py() or not prefix:
            cut = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
            lists = [cut.findall(" " + x if prefix else x) if x else [] for x in column.to_pylist()]
            return encoded(pa.array(lists, pa.list_(pa.string())), drop_empty=False)
        lists = pc.split_pattern(column, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        full = pc.not_equal(column, "").to_numpy(zero_copy_only=False)
        if not full.all():
            kept = np.repeat(full, np.diff(offsets))
            values = values.filter(pa.array(kept))
            offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) * full)])
        found = values.dictionary_encode()
        inner = pc.binary_join_element_wise(pa.scalar(""), found.dictionary, " ")
        return Words(offsets, found.indices.to_numpy(zero_copy_only=False), inner)

    @property
    def places(self) -> np.ndarray:
        """Place of every piece of the batch among the distinct chunks' pieces."""
        codes = self.words.codes
        return ranges(self.first[codes], self.counts[codes])

    @property
    def ids(self) -> np.ndarray:
        return self.flat_ids[self.places]

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every piece in the UTF-8 bytes of its text.

        A piece covers the source of its normalised bytes; the dummy prefix has none.
        """
        words, prefix = self.words, self.of.model.dummy_prefix
        spaces = pc.count_substring(words.dictionary, " ").to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False) + 2 * spaces
        # Normalised begin of every chunk within its text.
        each = sizes[words.codes].astype(np.int64)
        begins = np.cumsum(each) - each
        rows = words.rows
        filled = np.diff(words.offsets) > 0
        base = np.zeros(len(filled), np.int64)
        base[filled] = begins[words.offsets[:-1][filled]]
        begins = begins - base[rows]
        places, codes = self.places, words.codes
        ends = self.flat_ends[places].astype(np.int64)
        starts = np.zeros_like(ends)
        starts[1:] = ends[:-1]
        heads = np.cumsum(self.counts[codes]) - self.counts[codes]
        starts[heads[self.counts[codes] > 0]] = 0
        if self.sources is None:
            # Identity: each space mark is three normalised bytes for one source byte.
            lead = pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False) - pc.binary_length(
                pc.utf8_ltrim(words.dictionary, " ")
            ).to_numpy(zero_copy_only=False)
            lead = np.repeat(lead[codes].astype(np.int64), self.counts[codes])
            source = each - 2 * spaces[codes]
            at = np.cumsum(source) - source
            base[filled] = at[words.offsets[:-1][filled]]
            at = np.repeat(at - base[rows], self.counts[codes]) - (1 if prefix else 0)
            begin, end = (np.where(x <= 3 * lead, x // 3, x - 2 * lead) + at for x in (starts, ends))
            return np.maximum(begin, 0), np.maximum(end, 0)
        shift = np.repeat(begins, self.counts[codes])
        begin, end = np.zeros_like(starts), np.zeros_like(ends)
        for i, source in enumerate(self.sources):
            part = slice(self.offsets[i], self.offsets[i + 1])
            marked = self._marked(i, source, prefix)
            begin[part], end[part] = marked[(starts + shift)[part]], marked[(ends + shift)[part]]
        return begin, end

    def _marked(self, i: int, source: np.ndarray, prefix: bool) -> np.ndarray:
        """Source offset of every byte of the marked, prefixed normalised text."""
        data = self.of.map.normalise(self.column[i].as_py().encode())[0]
        wide = np.where(np.frombuffer(data, np.uint8) == 0x20, 3, 1)
        out = np.append(np.repeat(source[:-1], wide), source[-1])
        return np.concatenate([np.zeros(3, np.int64), out]) if prefix and data else out

    @property
    def begins(self) -> np.ndarray:
        return self.spans()[0]

    @property
    def ends(self) -> np.ndarray:
        return self.spans()[1]

    def joined(self, values: list[bytes]) -> pa.Array:
        """For every text, the values of its chunks one after another."""
        found = pa.array(values, pa.binary()).take(pa.array(self.words.codes))
        lists = pa.ListArray.from_arrays(pa.array(self.words.offsets, pa.int32()), found)
        return pc.binary_join(lists, b"")

    def chunk_ids(self) -> list[list[int]]:
        flat = self.flat_ids.tolist()
        return [flat[a : a + n] for a, n in zip(self.first.tolist(), self.counts.tolist(), strict=True)]

    def written_ids(self) -> list[bytes]:
        """Every text's ids in decimal, joined by commas."""
        found = self.joined([b"".join(b"%d," % x for x in ids) for ids in self.chunk_ids()])
        return [x[:-1] for x in found.to_pylist()]

    def decoded(self) -> list[bytes]:
        """Every text's ids decoded, as UTF-8.

        A chunk's bytes form whole characters, so chunks decode apart; the first
        loses the dummy prefix.
        """
        shown = self.of.shown
        parts = [b"".join([shown[x] for x in ids]).replace(MARK, b" ") for ids in self.chunk_ids()]
        cut = 1 if self.of.model.dummy_prefix else 0
        return [x[cut:] for x in self.joined(parts).to_pylist()]


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, begins, ends) of every row; spans are offsets in the text's UTF-8 bytes.

    A null or empty text has no piece; null ids and repeated rows are kept; other
    columns take no part; an empty table gives no row. One narrow pass.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Encoded(opened(path), batch.column("text"))
        ends = pa.array(found.offsets, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (found.ids.astype(np.int32), *found.spans())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "ids", "begins", "ends"])

    return map_text(columns(df, doc_id=id_col, text=text_col), step, "doc_id long, ids array<int>, begins array<int>, ends array<int>", most=SLICE)


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids decode to the empty text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = opened(path)
        found = [pieces.decode(x or []) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "text"])

    return columns(df, doc_id=id_col, ids=ids_col).mapInArrow(lambda batches: map(step, batches), "doc_id long, text string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"


def digest_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents() and the decoding of its ids, each document reduced to digests.

    (doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32): ids in decimal joined
    by commas, the decoded text in UTF-8, and begin and end of every piece as
    little-endian unsigned 32-bit pairs. Rows as encode_documents() has them.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Encoded(opened(path), batch.column("text"))
        spans = np.stack(found.spans(), axis=1).astype("<u4")
        at = found.offsets
        arrays = [
            batch.column("doc_id"),
            pa.array(np.diff(at), pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in found.written_ids()]),
            pa.array([hashlib.sha256(x).hexdigest() for x in found.decoded()]),
            pa.array([zlib.crc32(spans[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in DIGEST.split(", ")])

    return map_text(columns(df, doc_id=id_col, text=text_col), step, DIGEST, most=SLICE)

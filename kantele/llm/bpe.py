"""Byte-pair tokenizer files of the tokenizers library, encoded batch by batch.

Texts are cut at white space into chunks whose ids do not depend on their
neighbours. A batch's distinct chunks are encoded once: plain ones by a byte-pair
merge engine built from the file's merges, any other by the tokenizers library
itself. A bounded memo carries chunks from batch to batch.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Words, encoded, ranges, texts

#: Pre-tokens that a worker's memo holds, give or take one batch.
MEMO = 400_000
#: Unicode white space: fixed values.
SPACES = " \t\n\r\x0b\x0c\x85\xa0  -     　"
#: Letters that need no normalisation and on whose class all libraries agree.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
CHUNK = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
FULL = re.compile(f"[^{SPACES}]+")
#: A text with any of these is cut by CHUNK, any other at single spaces.
UNEVEN = "  |\n | \n|[\t\r\x0b\x0c\x1c-\x1f\u0085   -     　]"
#: A chunk with any of these, or with a special token, goes to the library.
NOT_PLAIN = f"[^\\x20-\\x7e\\n{LETTERS}]"
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^ \\n{LETTERS}0-9]+")
SPACED = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^ \\n{LETTERS}0-9]+|[ \\n]+(?![^ \\n])|[ \\n]+"
)


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePairs:
    """Encoder of one tokenizer file; pickles as its path."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.size = self.library.get_vocab_size()
        self.suffix = model.get("end_of_word_suffix") or ""
        names = [x.get("type") for x in ((spec.get("normalizer") or {}).get("normalizers") or [])]
        kind = (spec.get("pre_tokenizer") or {}).get("type")
        #: word: words alone, in lower case; spaced: a word with its white space.
        self.form = {("", "ByteLevel"): "spaced", ("</w>", "Sequence"): "word"}.get((self.suffix, kind))
        if model["type"] != "BPE" or self.form is None or (self.form == "word") != (names == ["NFC", "Replace", "Lowercase"]):
            raise ValueError(f"{path} is not a byte-level or word-end byte-pair tokenizer")
        letters, end = byte_letters(), b"\xff" if self.suffix else b""

        def raw(token: str) -> bytes:
            ends = self.suffix and token.endswith(self.suffix) and token != self.suffix
            return bytes(letters[c] for c in (token[: -len(self.suffix)] if ends else token)) + (end if ends else b"")

        ranks = {bytes([b]): b for b in range(256)}
        if end:
            ranks |= {bytes([b]) + end: 256 + b for b in range(256)}
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault(raw(left + right), len(ranks))
        of = np.full(len(ranks), -1, np.int64)
        for token, number in model["vocab"].items():
            if set(token) <= letters.keys() | set(self.suffix) and (rank := ranks.get(raw(token))) is not None:
                of[rank] = number
        self.of = of.tolist()
        self.end = end
        self.engine = tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.memo: dict[str, bytes] = {}

    def __reduce__(self):
        return (opened, (self.path,))

    def word(self, text: str) -> bytes:
        """Ids of one plain pre-token, packed."""
        of = self.of
        return array(self.code, [of[x] for x in self.engine._encode_single_piece(text.encode() + self.end)]).tobytes()

    def other(self, text: str) -> bytes:
        """Ids of one chunk by the tokenizers library, packed."""
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, found: pa.Array) -> np.ndarray:
        """Whether the own engine may encode a chunk."""
        odd = pc.match_substring_regex(found, NOT_PLAIN)
        for name in self.special:
            odd = pc.or_(odd, pc.match_substring(found, name))
        return pc.invert(odd).to_numpy(zero_copy_only=False)

    def chunks(self, column: pa.Array) -> Words:
        """Chunks of every text, distinct ones once."""
        if self.form == "word":
            if not pc.any(pc.match_substring_regex(column, "[\x1c-\x1f]")).as_py():
                return encoded(pc.utf8_split_whitespace(column), drop_empty=True)
            lists = [FULL.findall(x) for x in column.to_pylist()]
            return encoded(pa.array(lists, pa.list_(pa.string())), drop_empty=True)
        uneven = pc.match_substring_regex(column, UNEVEN).to_numpy(zero_copy_only=False)
        if uneven.any():
            lists = [CHUNK.findall(x) if odd else _spaced(x) for x, odd in zip(column.to_pylist(), uneven, strict=True)]
            return encoded(pa.array(lists, pa.list_(pa.string())), drop_empty=True)
        # Every chunk but a text's first begins with its space.
        lists = pc.split_pattern(column, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        firsts = offsets[:-1]
        found = values.dictionary_encode()
        codes = found.indices.to_numpy(zero_copy_only=False).copy()
        head = values.take(pa.array(firsts)).dictionary_encode()
        codes[firsts] = head.indices.to_numpy(zero_copy_only=False) + len(found.dictionary)
        inner = pc.binary_join_element_wise(pa.scalar(""), found.dictionary, " ")
        return Words(offsets, codes, pa.concat_arrays([inner, head.dictionary]))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts); null is empty.

        The same ids as the tokenizers library gives without special tokens.
        """
        column = texts(column)
        if len(self.memo) > MEMO:
            self.memo.clear()
        found = self.chunks(column)
        memo, word = self.memo, self.word
        cut = WORD.findall if self.form == "word" else SPACED.findall
        lower = self.form == "word"
        packed: list[bytes] = []
        pieces: list[int] = []
        for text, plain in zip(found.dictionary.to_pylist(), self.plain(found.dictionary), strict=True):
            if plain:
                parts = cut(text.lower() if lower else text)
                for part in parts:
                    ids = memo.get(part)
                    if ids is None:
                        ids = word(part)
                        if len(part) <= 64:
                            memo[part] = ids
                    packed.append(ids)
                pieces.append(len(parts))
            else:
                packed.append(self.other(text))
                pieces.append(1)
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)))]) // self.kind.itemsize
        bounds = ends[np.concatenate([[0], np.cumsum(np.array(pieces, np.int64))])]
        flat = np.frombuffer(b"".join(packed), self.kind)
        counts = np.diff(bounds)[found.codes]
        offsets = np.concatenate([[0], np.cumsum(counts)])[found.offsets]
        return flat[ranges(bounds[:-1][found.codes], counts)], offsets


def _spaced(text: str) -> list[str]:
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)]


_OPEN: dict[str, BytePairs] = {}


def opened(path: str) -> BytePairs:
    """The encoder of a file, one in each process."""
    if path not in _OPEN:
        _OPEN[path] = BytePairs(path)
    return _OPEN[path]

"""Token counts by greedy longest match in linear time.

A vocabulary trie over UTF-8 bytes carries, at each node, a failure link and the
number of pieces that taking the link pops. A word is read once, byte by byte;
whenever no child fits, the popped count is added and the link taken. No piece is
ever built. Every single byte counts as a piece, so that any word has a count.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns, map_text, words
from .spm_model import NORMAL, SPACE, SpmModel

#: Longer words are read one by one, not in step with the others.
STEP_BYTES = 64


def vocabulary(path: str) -> list[str]:
    """Normal pieces of a SentencePiece model; word-initial ones begin with its space mark."""
    model = SpmModel.read(path)
    return [p for p, kind in zip(model.pieces, model.kinds, strict=True) if kind == NORMAL]


class LongestMatch:
    """Longest-match automaton of a vocabulary.

    A word ``w`` is read as ``mark + w``; pieces that begin with ``mark`` are the
    word-initial ones. Without any such piece a word is read as it is. Empty and
    repeated pieces change nothing; without pieces every byte counts.
    """

    def __init__(self, pieces: Iterable[str], mark: str = SPACE):
        self.mark, pieces = mark.encode(), list(pieces)
        child: list[dict[int, int]] = [{}]
        token = [False]

        def add(piece: bytes) -> None:
            node = 0
            for byte in piece:
                following = child[node].get(byte)
                if following is None:
                    following = child[node][byte] = len(child)
                    child.append({})
                    token.append(False)
                node = following
            token[node] = True

        for byte in range(256):
            add(bytes([byte]))
        for piece in pieces:
            if piece:
                add(piece.encode())
        link, popped, tail = ([0] * len(child) for _ in range(3))
        queue = deque([0])
        while queue:
            above = queue.popleft()
            for byte, node in child[above].items():
                if token[node]:
                    popped[node] = 1
                else:
                    state, count = link[above], popped[above]
                    while byte not in child[state]:
                        count += popped[state]
                        state = link[state]
                    link[node], popped[node] = child[state][byte], count
                tail[node] = popped[node] + tail[link[node]]
                queue.append(node)
        self.child = child
        self.link, self.popped, self.tail = (np.array(x, np.int64) for x in (link, popped, tail))
        edges = sorted((node << 8 | byte, to) for node, x in enumerate(child) for byte, to in x.items())
        self.edges = np.array([k for k, _ in edges], np.int64)
        self.targets = np.array([to for _, to in edges], np.int64)
        # A vocabulary without word-initial pieces reads words as they are.
        self.start = 0
        self.marked = bool(self.mark) and any(piece.startswith(mark) for piece in pieces)
        for byte in self.mark if self.marked else b"":
            self.start = child[self.start][byte]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "child"}

    def count(self, word: bytes) -> int:
        """Pieces of one word, byte by byte."""
        state, total = self.start, 0
        for byte in word:
            while True:
                key = state << 8 | byte
                at = int(np.searchsorted(self.edges, key))
                if at < len(self.edges) and self.edges[at] == key:
                    state = int(self.targets[at])
                    break
                total += int(self.popped[state])
                state = int(self.link[state])
        return total + int(self.tail[state])

    def counts(self, found: pa.Array) -> np.ndarray:
        """Pieces of every word of a string array, all words in step."""
        offsets = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1].astype(np.int64)
        data = np.frombuffer(found.buffers()[2] or b"", np.uint8)
        sizes = np.diff(offsets)
        out = np.zeros(len(found), np.int64)
        order = np.argsort(-sizes, kind="stable")
        for at in order[: int(np.count_nonzero(sizes > STEP_BYTES))]:
            out[at] = self.count(data[offsets[at] : offsets[at + 1]].tobytes())
        order = order[int(np.count_nonzero(sizes > STEP_BYTES)) :]
        state, total = np.full(len(order), self.start), np.zeros(len(order), np.int64)
        starts, sizes = offsets[order], sizes[order]
        for step in range(int(sizes[0]) if len(sizes) else 0):
            open_ = np.arange(int(np.searchsorted(-sizes, -step, side="left")))
            byte = data[starts[open_] + step].astype(np.int64)
            while len(open_):
                key = state[open_] << 8 | byte
                at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                hit = self.edges[at] == key
                state[open_[hit]] = self.targets[at[hit]]
                open_, byte = open_[~hit], byte[~hit]
                total[open_] += self.popped[state[open_]]
                state[open_] = self.link[state[open_]]
        out[order] = total + self.tail[state]
        return out


def token_counts(
    df: DataFrame, automaton: LongestMatch, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts count 0 words and 0
    tokens; a null id stays null; repeated rows give repeated rows; other columns
    take no part; an empty table gives no row. One narrow pass, no shuffle.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = words(batch.column("text"))
        each = automaton.counts(found.dictionary)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found.counts, pa.int64()), pa.array(found.sums(each[found.codes]), pa.int64())],
            ["doc_id", "n_words", "n_tokens"],
        )

    return map_text(columns(df, doc_id=id_col, text=text_col), step, "doc_id long, n_words long, n_tokens long")

"""Quality rules: document statistics judged by gradient-boosted trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import boosting
from .common import Words, columns, encoded, keep, map_text, texts, words
from .labels import SAMPLE, labelled

#: Features of the trees and the way each may move the score: shares of symbols, of
#: repeated lines and words, and of capitals never raise it.
FEATURES = {
    "log_words": 0, "word_chars": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1,
    "distinct_words": 0, "capitals": -1, "digits": 0, "line_words": 0, "stops": 0,
}
SIGNS = list(FEATURES.values())
LEAST_WORDS, MOST_REPEATED = 50, 50


def distinct(rows: np.ndarray, codes: np.ndarray, size: int, n: int) -> np.ndarray:
    """Distinct codes of each of n rows."""
    found = np.unique(rows.astype(np.int64) * max(size, 1) + codes)
    return np.bincount(found // max(size, 1), minlength=n)


def repeated_words(found: Words) -> np.ndarray:
    """Words of each text inside a 3-word window found twice or more in it."""
    n, codes = len(found.codes), found.codes.astype(np.int64)
    if n < 3:
        return np.zeros(len(found.offsets) - 1, np.int64)
    size, rows = max(len(found.dictionary), 1), found.rows
    pair = codes[:-2] * size + codes[1:-1]
    if size >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
        third = np.unique(codes[2:], return_inverse=True)[1]
        key, low = pair, third
    else:
        key, low = pair * size + codes[2:], None
    here = rows[:-2] == rows[2:]
    # A hash narrows to windows that may repeat; those are compared exactly.
    mixed = (key.astype(np.uint64) + rows[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    if low is not None:
        mixed ^= low.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    at = np.flatnonzero(here)
    mixed = mixed[at]
    ordered = np.sort(mixed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        place = np.minimum(np.searchsorted(twice, mixed), len(twice) - 1)
        at = at[twice[place] == mixed]
    else:
        at = at[:0]
    covered = np.zeros(n, bool)
    if len(at):
        keys = [key[at], rows[at]] if low is None else [low[at], key[at], rows[at]]
        order = np.lexsort(keys)
        same = np.ones(len(at) - 1, bool)
        for k in keys:
            same &= k[order][1:] == k[order][:-1]
        hit = np.zeros(len(at), bool)
        hit[1:] |= same
        hit[:-1] |= same
        hits = at[order[hit]]
        for step in range(3):
            covered[hits + step] = True
    return found.sums(covered.astype(np.int64))


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(base counts, features) of every text."""
    column = texts(column)
    n = len(column)
    found = words(column)
    counts = found.counts

    def total(of: pa.Array) -> np.ndarray:
        return found.sums(of.to_numpy(zero_copy_only=False).astype(np.int64)[found.codes])

    d = found.dictionary
    chars, symbols = total(pc.utf8_length(d)), total(pc.count_substring_regex(d, r"[#*$%&|<>]"))
    capitals, digits = total(pc.count_substring_regex(d, r"\p{Lu}")), total(pc.count_substring_regex(d, r"[0-9]"))
    stops = total(pc.match_substring_regex(d, r"[.!?]$").cast(pa.int64()))
    lines = encoded(pc.split_pattern(column, "\n"), drop_empty=False)
    full = pc.match_substring_regex(lines.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    kept = full[lines.codes] if len(lines.codes) else np.zeros(0, bool)
    rows, codes = lines.rows[kept], lines.codes[kept]
    n_lines = np.bincount(rows, minlength=n)
    dup = n_lines - distinct(rows, codes, len(lines.dictionary), n)
    repeat = repeated_words(found)
    base = {"n_words": counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}
    per = np.maximum(counts, 1)
    features = np.stack(
        [
            np.log1p(counts), chars / per, symbols / per, dup / np.maximum(n_lines, 1), repeat / per,
            distinct(found.rows, found.codes, len(d), n) / per, capitals / np.maximum(chars, 1), digits / np.maximum(chars, 1),
            counts / np.maximum(n_lines, 1), stops / per,
        ],
        axis=1,
    )
    return base, features


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> boosting.Trees:
    """Trees for P(quality = 1), fitted on at most ``most`` labelled documents.

    One row of features for each labelled id comes to the driver, however often the
    id is repeated (``labelled``). Without labels the trees are none and judge() goes
    by their first guess.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, x = statistics(batch.column("text"))
        lists = pa.array(x.tolist(), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], ["doc_id", "label", "x"])

    found = labelled(docs, labels, "quality", most, id_col=id_col, text_col=text_col)
    rows = sorted(map_text(found, step, "doc_id long, label int, x array<double>").collect())
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return boosting.fit(x, np.array([r["label"] for r in rows], float), SIGNS)


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, quality double"
)


def failed(base: dict[str, np.ndarray]) -> np.ndarray:
    """Too few words, or too many of them in windows that repeat."""
    return (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])


def judge(df: DataFrame, trees: boosting.Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``base_failed``: fewer than 50 words, or over
    half the words in windows that repeat. ``kept``: not base_failed, and a quality
    of at least 0.5. A null or empty text has no word, so it fails; null ids and
    repeated rows are kept; other columns take no part; an empty table gives no row.
    One narrow pass.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, x = statistics(batch.column("text"))
        quality = trees.score(x)
        bad = failed(base)
        arrays = [batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in base.values())]
        arrays += [pa.array(bad), pa.array(~bad & (quality >= 0.5)), pa.array(quality)]
        return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in RESULT.split(", ")])

    return map_text(columns(df, doc_id=id_col, text=text_col), step, RESULT)


def keep_good(docs: DataFrame, trees: boosting.Trees, text_col: str = "text") -> DataFrame:
    """The rows that judge() would keep, with all their columns.

    Null and empty texts fail the base rules and go; rows without an id are judged by
    their text like any other; repeated rows stay or go together; other columns,
    whatever their names, go along; an empty table gives an empty one. One narrow pass.
    """

    def verdict(column: pa.Array) -> np.ndarray:
        base, x = statistics(column)
        return ~failed(base) & (trees.score(x) >= 0.5)

    return keep(docs, verdict, text_col)

"""Token counts, packing and token files against the libraries and brute force."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kantele.llm import bpe, packing, tokencount, tokenfile

BYTES, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def automaton():
    return tokencount.LongestMatch(tokencount.vocabulary(PIECES))


def greedy(vocabulary: set[bytes], word: bytes, mark: bytes) -> int:
    data, count, at = mark + word, 0, 0
    while at < len(data):
        stop = min(len(data), at + 60)
        while stop > at + 1 and data[at:stop] not in vocabulary:
            stop -= 1
        at, count = stop, count + 1
    return count


@given(st.lists(st.text(alphabet="abthe▁nigé日😀", min_size=1, max_size=90), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_longest_match(words):
    pieces = ["▁a", "▁th", "the", "▁the", "hen", "nig", "ing", "é日", "▁é", "bt", "nigh", "日"]
    machine = tokencount.LongestMatch(pieces)
    known = {x.encode() for x in pieces}
    expected = [greedy(known, w.encode(), "▁".encode()) for w in words]
    assert machine.counts(pa.array(words)).tolist() == expected
    assert [machine.count(w.encode()) for w in words] == expected


def test_vocabularies_without_the_mark():
    """Words are read as they are where no piece is word-initial, whatever bytes the mark has."""
    machine = tokencount.LongestMatch(["the", "a", "the", ""])
    assert machine.counts(pa.array(["the", "a", "then", "at", ""])).tolist() == [1, 1, 2, 2, 0]
    assert [machine.count(w) for w in (b"the", b"then", b"")] == [1, 2, 0]
    assert tokencount.LongestMatch([]).counts(pa.array(["abc", "é"])).tolist() == [3, 2]
    assert tokencount.LongestMatch(["_the", "the"], "_").counts(pa.array(["the", "thethe", "x"])).tolist() == [1, 2, 2]


def test_token_counts(spark, odd, automaton):
    known = {x.encode() for x in tokencount.vocabulary(PIECES)}
    rows = tokencount.token_counts(odd, automaton).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    import re

    assert len(rows) == odd.count()
    for row in rows:
        found = re.findall("[^\x20\x09-\x0d]+", texts[row.doc_id])
        assert row.n_words == len(found)
        assert row.n_tokens == sum(greedy(known, w.encode(), "▁".encode()) for w in found)
    assert tokencount.token_counts(odd.limit(0), automaton).count() == 0


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_byte_pairs_equal_the_library(path, odd):
    library, encoder = Tokenizer.from_file(path), bpe.opened(path)
    texts = [r.text for r in odd.collect()]
    for group in ([x] for x in texts):
        ids, _ = encoder.encode(pa.array(group, pa.string()))
        assert ids.tolist() == library.encode(group[0] or "", add_special_tokens=False).ids
    ids, ends = encoder.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
@given(st.lists(st.text(alphabet="abcTHE 's'rell\n\té😀ß1<|>_- ", max_size=60), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_byte_pairs_on_random_texts(path, texts):
    library, encoder = Tokenizer.from_file(path), bpe.opened(path)
    ids, ends = encoder.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def documents(path, rows, end=1):
    library = Tokenizer.from_file(path)
    return {i: [*library.encode(x or "", add_special_tokens=False).ids, end] for i, x in rows}


@given(st.lists(st.integers(1, 60), max_size=60), st.integers(1, 5), st.integers(0, 8))
@settings(max_examples=200, deadline=None)
def test_packing_keeps_every_id(lengths, most, top_up):
    seen = defaultdict(set)
    left = []
    for window, done in packing.packed(iter(lengths), 16, most, top_up):
        at = 0
        for (document, start, length), offset in window:
            assert offset == at and length > 0
            at += length
            span = set(range(start, start + length))
            assert not span & seen[document]
            seen[document] |= span
        assert at <= 16
        if not done:
            left.append(window)
    assert len(left) <= most
    assert [len(seen[i]) for i in range(len(lengths))] == lengths


@pytest.mark.parametrize("parts,group", [(1, 64), (7, 2)])
def test_pack_documents(spark, parts, group):
    rows = [(i, "the cat sat " * (i * 7 % 90)) for i in range(150)] + [(900, None), (901, ""), (902, "long " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", pa_lit("x")).repartition(parts)
    found = packing.pack_documents(df, BYTES, open_windows=4, group=group, with_ids=True).collect()
    expected = documents(BYTES, rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        ids = expected[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(expected[r.doc_id]) and r.length == len(ids)
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, spans in pieces.items():
        assert sum(n for _, n in spans) == len(expected[doc])
    assert pieces.keys() == expected.keys()
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    tokens = sum(len(x) for x in expected.values())
    assert len(sequences) <= tokens / 2048 * 1.1 + 8


def pa_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_pack_odd_and_empty(spark, odd):
    found = packing.pack_documents(odd, BYTES).collect()
    assert {r.doc_id for r in found} == {r.doc_id for r in odd.collect()}
    assert packing.pack_documents(odd.limit(0), BYTES).count() == 0


def test_token_store(spark, odd, tmp_path):
    store = tokenfile.write_store(odd.repartition(3), WORDS, f"file://{tmp_path}/store")
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    found = sorted(store.documents(with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [i for i, _ in rows]
    library, at = Tokenizer.from_file(WORDS), 0
    for (_, text), row in zip(rows, found, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert row.ids == ids and row.start == at and row.n_tokens == len(ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert [len(store.document(3)), len(store.document(5)), len(store.document(12345))] == [2, 1, 0]
    with pytest.raises(ValueError):
        tokenfile.Block(bytes(store.blocks().head()["data"]), b"another dictionary")


def test_token_store_of_one_id(spark, tmp_path, monkeypatch):
    """Rows that share an id, or have none, are spread over partitions and stay in order."""
    monkeypatch.setattr(tokenfile, "PART_IDS", 2000)
    rows = [(7, f"word {i} " * (i % 9)) for i in range(900)] + [(None, "same text here")] * 700 + [(i, "x") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    store = tokenfile.write_store(df, WORDS, f"file://{tmp_path}/hot")
    blocks = store.blocks().select("part", "n_docs", "first_id", "last_id").collect()
    assert len([b for b in blocks if b.first_id == b.last_id == 7]) > 3 and len([b for b in blocks if b.first_id is None]) > 1
    found = sorted(store.documents().collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert ids == sorted(ids) and len(ids) == len(rows)
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]
    assert len(store.document(7)) == 901


def test_the_dictionary_is_the_same_however_rows_lie(spark, tmp_path, monkeypatch):
    """The sample is of whole documents by hash: order and partitions play no part."""
    monkeypatch.setattr(tokenfile, "SAMPLE", 40)
    df = spark.createDataFrame([(i % 300, f"word{i % 50} and again " * (i % 30)) for i in range(900)], "doc_id long, text string")
    stores = [tokenfile.write_store(x, WORDS, f"file://{tmp_path}/{i}") for i, x in enumerate((df.repartition(5), df.coalesce(1).orderBy("text")))]
    assert stores[0].dictionary() == stores[1].dictionary()


def test_padding():
    assert [packing.padded(n) for n in (1, 3, 1024, 1500, 2048)] == [1, 2048, 1024, 2048, 2048]


def test_token_store_of_many_and_of_none(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i % 50} and again " * (i % 30)) for i in range(3000)], "doc_id long, text string")
    store = tokenfile.write_store(df, WORDS, f"file://{tmp_path}/many")
    assert len(store.dictionary()) > 1000
    expected = documents(WORDS, [(r.doc_id, r.text) for r in df.collect()])
    found = {r.doc_id: r for r in store.documents().collect()}
    assert {i: len(x) for i, x in expected.items()} == {i: r.n_tokens for i, r in found.items()}
    empty = tokenfile.write_store(df.limit(0), WORDS, f"file://{tmp_path}/none")
    assert empty.documents().count() == 0

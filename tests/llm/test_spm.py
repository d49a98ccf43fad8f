"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from kantele.llm import spm

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(library, group):
    pieces = spm.opened(PATH)
    found = spm.Encoded(pieces, pa.array(group, pa.string()))
    ids, (begins, ends) = found.ids, found.spans()
    written, decoded = found.written_ids(), found.decoded()
    for i, text in enumerate(group):
        text = text or ""
        part = slice(found.offsets[i], found.offsets[i + 1])
        expected = library.encode(text)
        assert ids[part].tolist() == expected
        assert written[i].decode() == ",".join(map(str, expected))
        assert decoded[i].decode() == library.decode(expected) == pieces.decode(expected)
        raw, at = text.encode(), 0
        for begin, end in zip(begins[part].tolist(), ends[part].tolist(), strict=True):
            assert begin == at
            at = end
        assert at == len(raw)


def test_equals_the_library(odd, library):
    texts = [r.text for r in odd.collect()]
    for text in texts:
        same(library, [text])
    same(library, texts)


def test_spans_equal_the_library(library):
    text = "Größe und naïve  Wörter, the whole thing\nand so on 12 é"
    _, begins, ends = spm.opened(PATH).encode(text)
    pieces = library.encode(text, return_type="proto").pieces
    plain = [i for i, p in enumerate(pieces) if not p.piece.startswith("<0x")]
    assert [(begins[i], ends[i]) for i in plain] == [(pieces[i].begin, pieces[i].end) for i in plain]


@given(st.lists(st.text(alphabet="ab theing▁ \n\té日😀ßñ<0x1>", max_size=60), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_random_texts(library, texts):
    same(library, texts)


def test_decode_any_ids(library):
    draw = random.Random(5)
    for _ in range(400):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(3, 259), 29871, 1, 2]) for _ in range(draw.randrange(9))]
        assert spm.opened(PATH).decode(ids) == library.decode(ids), ids


def test_documents(spark, odd, library):
    rows = {(r.doc_id, r.text): library.encode(r.text or "") for r in odd.collect()}
    texts = dict(rows.keys())
    found = spm.encode_documents(odd, PATH).collect()
    assert len(found) == odd.count()
    for r in found:
        assert r.ids == rows[r.doc_id, texts[r.doc_id]]
    for r in spm.digest_documents(odd, PATH).collect():
        ids = rows[r.doc_id, texts[r.doc_id]]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    back = spm.decode_documents(spm.encode_documents(odd, PATH), PATH)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(i, library.decode(ids)) for (i, _), ids in rows.items()}
    assert spm.encode_documents(odd.limit(0), PATH).count() == 0


def charsmap(rules: dict[str, str]) -> bytes:
    """A compiled character map: a double array laid out one node at a time."""
    units, replacements = {0: 0}, b""
    values, bases = {}, set()
    for key, text in rules.items():
        values[key.encode()] = len(replacements)
        replacements += text.encode() + b"\0"
    queue = [(b"", 0)]
    while queue:
        prefix, at = queue.pop(0)
        labels = sorted({k[len(prefix)] for k in values if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in values
        base = next(b for b in range(1, 1 << 20) if b ^ at not in bases and all((b ^ at ^ x) not in units for x in [*([0] if leaf else []), *labels]))
        bases.add(at ^ base)
        units[at] |= base << 10 | leaf << 8
        if leaf:
            units[at ^ base] = values[prefix] | 1 << 31
        for label in labels:
            units[at ^ base ^ label] = label
        for label in labels:
            queue.append((prefix + bytes([label]), at ^ base ^ label))
    array = np.zeros(max(units) + 256, "<u4")
    for at, unit in units.items():
        array[at] = unit
    return (len(array) * 4).to_bytes(4, "little") + array.tobytes() + replacements


def test_character_map():
    rules = {"\ufb01": "fi", "e\u0301": "\u00e9", "e": "E", "\uff21": "A", "AB": "x"}
    made = spm.CharacterMap(charsmap(rules))
    data = "\ufb01n cafe\u0301 e\uff21AB\u65e5A".encode()
    out, source = made.normalise(data)
    assert out.decode() == "fin caf\u00e9 EAx\u65e5A"
    assert len(source) == len(out) + 1 and source[-1] == len(data)
    assert source[:3].tolist() == [0, 0, 3]


def test_longest_key_wins_and_spans_follow():
    made = spm.CharacterMap(charsmap({"a": "1", "abc": "3", "ﬁ": "fi", " ": " "}))
    out, source = made.normalise("abcabﬁ".encode())
    assert out == b"31bfi" and source.tolist() == [0, 3, 4, 5, 5, 8]
    pieces = spm.SentencePieces(PATH)
    pieces.map = spm.CharacterMap(charsmap({"ﬁ": "fi", "　": " "}))
    text = "a ﬁsh　tank"
    found = spm.Encoded(pieces, pa.array([text, "", "plain ﬁ"]))
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert found.ids[: found.offsets[1]].tolist() == library.encode("a fish tank")
    begins, ends = found.spans()
    raw = text.encode()
    cover = [raw[b:e] for b, e in zip(begins[: found.offsets[1]], ends[: found.offsets[1]], strict=True)]
    # Every byte lies in one span, in order; both pieces of a replacement that was cut cover its source.
    assert b"".join(cover) == raw
    assert begins[0] == 0 and ends[found.offsets[1] - 1] == len(raw)

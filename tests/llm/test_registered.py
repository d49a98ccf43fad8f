"""The queries as they are registered, on whole small tables, against brute force and the libraries."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from kantele.llm import packing, queries, simhash, tokencount

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r.text or "" for r in rows}


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text)


def by_id(found):
    rows = found.collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op1(spark, docs):
    known = {x.encode() for x in tokencount.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))}
    longest = max(map(len, known))

    def pieces(word):
        data, n, at = b"\xe2\x96\x81" + word.encode(), 0, 0
        while at < len(data):
            stop = next((s for s in range(min(len(data), at + longest), at + 1, -1) if data[at:s] in known), at + 1)
            at, n = stop, n + 1
        return n

    found, memo = by_id(queries.op1_token_counts(spark, SF)), {}
    for i, text in docs.items():
        each = [memo[w] if w in memo else memo.setdefault(w, pieces(w)) for w in split(text)]
        assert (found[i].n_words, found[i].n_tokens) == (len(each), sum(each))
    assert found.keys() == docs.keys()


def test_op3(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in docs.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op3_packing(spark, SF).collect():
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.length == len(piece) > 0 and r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for spans, whole in [*((pieces[i], len(ids[i])) for i in ids), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == whole if whole is not None else at <= 2048
    used = sum(map(len, ids.values()))
    assert used / sum(packing.padded(sum(n for _, n in s)) for s in sequences.values()) > 0.97


def test_op4(spark, docs):
    found = by_id(queries.op4_lm_scores(spark, SF))
    assert found.keys() == docs.keys()
    for i, r in found.items():
        assert r.n_tokens == len(split(docs[i])) and r.score == pytest.approx(r.target_loss - r.background_loss)


def test_op5(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = by_id(queries.op5_sentencepiece(spark, SF))
    for i, text in docs.items():
        ids = library.encode(text)
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert found.keys() == docs.keys()


def test_op6(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found, at = by_id(queries.op6_token_files(spark, SF)), 0
    for i in sorted(docs):
        ids = [*library.encode(docs[i], add_special_tokens=False).ids, 1]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert found.keys() == docs.keys()


def test_op7(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = queries.op7_main_text(spark, SF)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    rows = found.collect()
    assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in pages.select("page_id").collect())
    assert all(r.n_chars == len(r.text) for r in rows)


def test_op9(spark, docs):
    found = by_id(queries.op9_quality_rules(spark, SF))
    for i, text in docs.items():
        words = split(text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {j + k for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if split(x)]
        base = (len(words), sum(map(len, words)), sum(len(re.findall(r"[#*$%&|<>]", w)) for w in words), len(lines) - len(set(lines)), len(covered))
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert r.base_failed == failed and not (failed and r.kept)
    assert found.keys() == docs.keys() and any(r.kept for r in found.values())


def test_op10(spark, docs):
    def fingerprint(text):
        words = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(words[j : j + 3]) for j in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    ids = sorted(docs)
    prints = np.array([fingerprint(docs[i]) for i in ids], np.uint64)
    forest = simhash.Forest(len(ids))
    for j in range(len(ids)):
        for k in np.flatnonzero(np.bitwise_count(prints ^ prints[j]) <= 3).tolist():
            forest.link(j, k)
    found = by_id(queries.op10_simhash(spark, SF))
    assert {i: (found[i].fingerprint, found[i].component_id) for i in ids} == {i: (f"{int(p):016x}", ids[forest.root(j)]) for j, (i, p) in enumerate(zip(ids, prints, strict=True))}


@pytest.mark.parametrize("name", ["quality_base", "word_counts", "op7_main_text", "op10_simhash"])
@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_equals_sql(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    answer = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in answer.description]
    found = queries.QUERIES[name](spark, folder)
    assert sorted(found.columns) == sorted(names)
    assert sorted(tuple(r) for r in found.select(names).collect()) == sorted(answer.fetchall())


def test_sql_of_simhash_on_odd_texts(spark, odd, tmp_path):
    """Shingles of every length up to 100 bytes, odd characters, nulls, repeated rows and ids."""
    long = spark.createDataFrame([(1000 + i, "Zé" * (i // 3) + "x" * (i % 3)) for i in range(100)], "doc_id long, text string")
    odd.select("doc_id", "text").union(long).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = queries.op10_simhash(spark, str(tmp_path)).select("doc_id", "fingerprint", "component_id").collect()
    assert len(found) == odd.count() + 100
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, con.execute(f"select doc_id, fingerprint, component_id from ({queries.ORACLE_SQL['op10_simhash']})").fetchall()))

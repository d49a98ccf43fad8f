"""The pipeline stage by stage against brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from test_simhash import brute, components
from tokenizers import Tokenizer

import corpus_pipeline
from kantele.llm import quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "SimHash near-dedup", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}

    civil = corpus_pipeline.civil(spark, docs, SF)
    model = toxicity.fit(docs, labels)
    expected = {i for i, r in rows.items() if model.score(pa.array([r.text]))[0] < 0.5}
    assert {r.doc_id for r in civil.collect()} == expected and civil.columns == docs.columns

    good = corpus_pipeline.good(spark, civil, SF)
    trees = quality.fit(civil, labels)
    kept = set()
    for i in expected:
        base, x = quality.statistics(pa.array([rows[i].text]))
        if base["n_words"][0] >= 50 and 100 * base["n_repeat_words"][0] <= 50 * base["n_words"][0] and trees.score(x)[0] >= 0.5:
            kept.add(i)
    assert {r.doc_id for r in good.collect()} == kept and good.columns == docs.columns

    one = corpus_pipeline.unique(spark, good, SF)
    prints = {i: brute(rows[i].text) for i in kept}
    keys = sorted(set(prints.values()))
    root = dict(zip(keys, components(keys), strict=True))
    least = {}
    for i in sorted(kept):
        least.setdefault(root[prints[i]], i)
    found = one.collect()
    assert sorted(r.doc_id for r in found) == sorted(least.values()) and sorted(one.columns) == sorted(docs.columns)
    assert all(r.text == rows[r.doc_id].text for r in found)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(dict)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r.doc_id][r.start] = r
    assert pieces.keys() == set(least.values())
    for i, spans in pieces.items():
        ids, at = [*library.encode(rows[i].text, add_special_tokens=False).ids, 1], 0
        for start, r in sorted(spans.items()):
            assert start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_odd_documents(spark, odd):
    """Nulls, odd texts, repeated rows and columns named like the operators' own, at every stage."""
    extra = ["'f' as fingerprint", "0.5 as score", "cast(null as int) as label", "length", "doc_id as head", "1 as rows", "'m' as _hash", "text as data"]
    long = spark.createDataFrame([(500 + i % 40, " ".join(f"word{(i % 40) * 7 + j}" for j in range(90)) + ".", 1, "s") for i in range(60)], odd.schema)
    toxic = spark.createDataFrame([(700, "you are an idiot and a pathetic loser", 1, "s"), (None, "what an idiot, such trash", 1, "s")], odd.schema)
    # Ids far from those that have labels.
    docs = odd.union(long).union(toxic).selectExpr("doc_id + 1000000 as doc_id", "text", "'en' as lang", *extra).repartition(3)
    rows = docs.collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    source = spark.read.parquet(f"{SF}/documents.parquet")

    def found(df):
        assert sorted(df.columns) == sorted(docs.columns)
        return Counter((r.doc_id, r.text) for r in df.collect())

    # The stages fit on the documents they are given: with these, on none that has a label.
    model = toxicity.fit(docs, labels)
    scores = model.score(pa.array([r.text for r in rows]))
    civil = found(corpus_pipeline.civil(spark, docs, SF))
    assert civil == Counter((r.doc_id, r.text) for r, score in zip(rows, scores, strict=True) if score < 0.5)
    assert (None, "no id") in civil and (1000000, None) in civil and not any(i == 1000700 for i, _ in civil)

    for trees in (quality.fit(docs, labels), quality.fit(source, labels)):
        base, x = quality.statistics(pa.array([r.text for r in rows]))
        good = (base["n_words"] >= 50) & (100 * base["n_repeat_words"] <= 50 * base["n_words"]) & (trees.score(x) >= 0.5)
        assert found(quality.keep_good(docs, trees)) == Counter((r.doc_id, r.text) for r, kept in zip(rows, good, strict=True) if kept)
    assert found(corpus_pipeline.good(spark, docs, SF)).keys() >= {(r.doc_id, r.text) for r in rows if r.doc_id == 1000500}

    prints = [brute(r.text) for r in rows]
    keys = sorted(set(prints))
    root = dict(zip(keys, components(keys), strict=True))
    one = found(corpus_pipeline.unique(spark, docs, SF))
    assert set(one.values()) == {1} and one.keys() <= {(r.doc_id, r.text) for r in rows}
    kept = Counter(root[brute(text)] for _, text in one)
    assert kept == Counter(set(root[p] for p in prints))
    for i, text in one:
        same = [r.doc_id for r, p in zip(rows, prints, strict=True) if root[p] == root[brute(text)]]
        assert i == min((x for x in same if x is not None), default=None)

    library, tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r in rows:
        tokens[r.doc_id] += len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    packed = Counter()
    for r in corpus_pipeline.packed(spark, docs, SF).collect():
        packed[r.doc_id] += r.length
    assert packed == tokens

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0

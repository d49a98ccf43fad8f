"""SimHash fingerprints, the trie join and groups against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from kantele.llm import simhash


def brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall("[^\x20\x09-\x0d]+", text)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] if len(found) >= 3 else [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys):
    """Least index reachable over keys within 3 bits."""
    keys = np.array(keys, np.uint64)
    forest = simhash.Forest(len(keys))
    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(keys ^ keys[i]) <= 3):
            if j > i:
                forest.link(i, int(j))
    return [forest.root(i) for i in range(len(keys))]


@given(st.lists(st.text(alphabet="abAB é\n\x1c", max_size=40), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_fingerprints(group):
    group = [None, "", *group, "w " * 700]
    assert simhash.fingerprints(pa.array(group, pa.string())).tolist() == [brute(x) for x in group]


def clustered(draw, n, bits):
    centres = [draw.getrandbits(64) for _ in range(4)]
    return sorted({draw.choice(centres) ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(bits))}) for _ in range(n)})


def test_trie_join():
    draw = random.Random(3)
    for n, bits in ((2, 5), (60, 6), (900, 7), (700, 12)):
        keys = clustered(draw, n, bits)
        forest = simhash.Forest(len(keys))
        simhash.trie_join(np.array(keys, np.uint64), None, forest)
        assert [forest.root(i) for i in range(len(keys))] == components(keys)
        assert all((keys[a] ^ keys[b]).bit_count() <= 3 for a, b in forest.links)
        left, right = np.array(keys[::2], np.uint64), np.array(keys[1::2], np.uint64)
        forest = simhash.Forest(len(keys))
        simhash.trie_join(left, right, forest)
        expected = simhash.Forest(len(keys))
        for i, x in enumerate(left):
            for j in np.flatnonzero(np.bitwise_count(right ^ x) <= 3):
                expected.link(i, len(left) + int(j))
        assert [forest.root(i) for i in range(len(keys))] == [expected.root(i) for i in range(len(keys))]


def test_links_and_groups(spark, monkeypatch):
    draw = random.Random(4)
    keys = clustered(draw, 1500, 7) + [0, 7, 2**64 - 1]
    keys = sorted(set(keys))
    signed = [(int(np.uint64(k).astype(np.int64)),) for k in keys]
    expected = components(keys)
    for cell in (2000, 40):
        monkeypatch.setattr(simhash, "CELL", cell)
        links = simhash.near_links(spark.createDataFrame(signed, "fingerprint long"))
        got = {r.node: r.group for r in simhash.groups(links).collect()}
        classes = {}
        for i, (k,) in enumerate(signed):
            classes.setdefault(expected[i], set()).add(got.get(k, k))
        assert all(len(x) == 1 for x in classes.values())
        assert len({min(x) for x in classes.values()}) == len(classes)


def test_cell_links():
    """Runs of cells, small and large, against all their pairs."""
    draw = random.Random(9)
    cells, keys = [], []
    for cell, n in enumerate([1, 2, 8, 9, 1, 300, 3, 40]):
        some = clustered(draw, n, 6)
        cells += [cell] * len(some)
        keys += draw.sample(some, len(some))
    cells, keys = np.array(cells), np.array(keys, np.uint64)
    of, a, b = simhash.cell_links(cells, keys)
    assert (np.bitwise_count(a ^ b) <= 3).all()
    for cell in set(cells.tolist()):
        own = sorted(keys[cells == cell].tolist())
        forest = simhash.Forest(len(own))
        for x, y in zip(a[of == cell].tolist(), b[of == cell].tolist(), strict=True):
            forest.link(own.index(x), own.index(y))
        assert [forest.root(i) for i in range(len(own))] == components(own)
    # The same rows in batches that cut runs anywhere.
    whole = pa.RecordBatch.from_arrays([pa.array(cells), pa.array(keys.view(np.int64))], ["cell", "key"])
    expected = {tuple(sorted(p)) for p in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True)}
    for size in (1, 7, 64, 1000):
        out = list(simhash._linked(iter([whole.slice(i, size) for i in range(0, len(cells), size)])))
        found = {tuple(sorted(p)) for x in out for p in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)}
        assert found == expected


def test_keep_one_loses_no_text(spark):
    """Texts that share an id, repeated rows and rows without an id."""
    rows = [
        (5, "alpha beta gamma", 1), (5, "delta eps zeta", 2), (9, "delta eps zeta", 3), (9, "delta eps zeta", 3), (9, "delta eps zeta", 4),
        (None, "alpha beta gamma", 5), (None, "eta theta iota", 6), (None, "eta theta iota", 6), (7, None, 7), (8, "", 8), (6, "kappa", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int").repartition(3)
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    found = out.collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in found) == [(0, "eta theta iota"), (5, "alpha beta gamma"), (5, "delta eps zeta"), (6, "kappa"), (7, "")]
    assert simhash.keep_one(df.limit(0)).count() == 0
    many = spark.range(2000).selectExpr("id as doc_id", "'same words here' as text").union(spark.range(50).selectExpr("id + 5000", "concat('t', id, ' u', id)"))
    kept = simhash.keep_one(many).collect()
    assert len([r for r in kept if r.doc_id < 5000]) == 1 and min(r.doc_id for r in kept) == 0


def test_ids_shared_by_texts_link_nothing(spark):
    """Components go by fingerprints, not by an id that two texts share."""
    words = ["one two three", "four five six", "seven eight nine"]
    df = spark.createDataFrame([(4, words[0]), (4, words[1]), (2, words[1]), (3, words[2]), (None, words[2]), (None, "ten")], "doc_id long, text string")
    found = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(df).collect()}
    prints = [f"{brute(x):016x}" for x in [*words, "ten"]]
    assert found == {(4, prints[0]): 4, (4, prints[1]): 2, (2, prints[1]): 2, (3, prints[2]): 3, (None, prints[2]): 3, (None, prints[3]): None}


def test_groups_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (95, 95)] + [(200, 200 + i) for i in range(1, 50)]
    found = {r.node: r.group for r in simhash.groups(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 90: 90, 95: 90, 100: 90, **{i: 200 for i in range(200, 250)}}
    assert simhash.groups(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, odd):
    draw = random.Random(5)
    base = [" ".join(draw.choice("alpha beta gamma delta eps zeta eta".split()) + str(draw.randrange(40)) for _ in range(80)) for _ in range(30)]
    rows = [(i, base[i % 30] if i % 3 else base[i % 30].replace("alpha", "Alpha", 2) + " tail" * (i % 2)) for i in range(160)]
    rows += [(1000 + i, t) for i, t in enumerate([None, "", " ", "one", "ONE"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    prints = [brute(t) for _, t in rows]
    keys = sorted(set(prints))
    root = dict(zip(keys, components(keys), strict=True))
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        least[root[p]] = min(i, least.get(root[p], i))
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert found == {i: (f"{p:016x}", least[root[p]]) for (i, _), p in zip(rows, prints, strict=True)}
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    assert simhash.near_duplicates(odd.limit(0)).count() == 0

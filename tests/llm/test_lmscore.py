"""Cross-entropy difference against counting in dictionaries."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kantele.llm import lmscore as lm

SF = "/root/testdata/sf0.1"


def tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", text)


class Exact:
    """Counts of words and of pairs of them, in dictionaries."""

    def __init__(self, rows):
        self.texts = [tokens(x) for x in rows]
        self.single, self.pair = Counter(), Counter()
        for t in self.texts:
            self.single.update(t)
            self.pair.update(zip(t, t[1:], strict=False))
        self.n, self.scale, self.size = sum(self.single.values()), 1.0, 0

    def loss(self, t):
        total = 0.0
        for i, w in enumerate(t):
            p = (self.single[w] * self.scale + lm.ALPHA) / (self.n * self.scale + lm.ALPHA * self.size)
            if i:
                p = (self.pair[t[i - 1], w] * self.scale + lm.BETA * p) / (self.single[t[i - 1]] * self.scale + lm.BETA)
            total -= math.log(p)
        return total / max(1, len(t))


def matched(target, background):
    """Both models, with one vocabulary and the background scaled to the target's size."""
    a, b = Exact(target), Exact(background)
    a.size = b.size = len(a.single.keys() | b.single.keys()) + 1
    b.scale = a.n / b.n
    return a, b


@pytest.mark.parametrize("group", [64, 2])
def test_equals_dictionaries(spark, odd, monkeypatch, group):
    monkeypatch.setattr(lm, "GROUP", group)
    target = ["the cat sat on the mat", "a cat and a dog", None, ""]
    extra = ["the cat sat on the mat today", "unseen words only", "The  CAT\nsat"]
    t = spark.createDataFrame([(x,) for x in target], "text string")
    rows = [r.text for r in odd.collect()] + extra
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, x) for i, x in enumerate(extra)], "doc_id long, text string"))
    model = lm.Difference.fit(t, docs.repartition(5))
    a, b = matched(target, rows)
    found = lm.score_documents(docs, model).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for r in docs.collect():
        got = by_id[r.doc_id]
        assert got.n_tokens == len(tokens(r.text))
        assert got.target_loss == pytest.approx(a.loss(tokens(r.text)), rel=1e-9)
        assert got.background_loss == pytest.approx(b.loss(tokens(r.text)), rel=1e-9)
        assert got.score == pytest.approx(got.target_loss - got.background_loss)
    assert by_id[100].score < by_id[101].score
    assert lm.score_documents(odd.limit(0), model).count() == 0
    empty = lm.Difference.fit(t.limit(0), docs.limit(0))
    assert all(np.isfinite(r.score) for r in lm.score_documents(odd, empty).collect())


def test_documents_with_target_passages_score_lower(spark):
    """Documents of which a passage makes up a tenth or more, against all without one."""
    docs, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    model = lm.Difference.fit(benchmark, docs)
    passages = [r.text for r in benchmark.collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    hits = {i: max((len(p) for p in passages if p[:60] in t), default=0) / len(t) for i, t in texts.items() if t}
    scores = {r.doc_id: r.score for r in lm.score_documents(docs, model).collect() if r.n_tokens >= 50}
    inside = np.array([s for i, s in scores.items() if hits[i] >= 0.1])
    outside = np.array([s for i, s in scores.items() if hits[i] == 0])
    assert len(inside) >= 10
    assert np.mean([(s < outside).mean() for s in inside]) > 0.9


def test_pairs_stay_within_a_text():
    of, offsets = lm.classes(pa.array(["a b", "", "c", "d e f"]))
    _, second = lm.pairs(of, offsets)
    assert second.tolist() == [1, 4, 5]


@pytest.mark.parametrize("other", [False, True])
def test_counts_of_many_words_are_exact(spark, other):
    """Many words: none shares a count with another."""
    rng = np.random.default_rng(3)
    rows = [" ".join(f"w{x}" for x in rng.integers(0, 400_000, 500)) for _ in range(3000)]
    target = rows[:50] + ["w1 w2 w3 only here"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    a, b = matched(target, rows)
    assert a.size > 300_000
    model = lm.Difference.fit(spark.createDataFrame([(x,) for x in target], "text string"), docs)
    found = lm.score_documents(docs.where("doc_id < 300") if other else docs, model).where("doc_id < 300").collect()
    assert len(found) == 300
    for r in found:
        t = b.texts[r.doc_id]
        assert (r.n_tokens, r.target_loss, r.background_loss) == (500, pytest.approx(a.loss(t), rel=1e-9), pytest.approx(b.loss(t), rel=1e-9))

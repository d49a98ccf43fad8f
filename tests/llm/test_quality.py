"""Quality statistics against brute force; trees against their constraints."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kantele.llm import boosting, quality

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    found = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(zip(found, found[1:], found[2:], strict=False))
    covered = set()
    for i, w in enumerate(zip(found, found[1:], found[2:], strict=False)):
        if windows[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return [len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def check(group):
    base, x = quality.statistics(pa.array(group, pa.string()))
    for i, text in enumerate(group):
        assert [int(v[i]) for v in base.values()] == brute(text), text
    assert np.isfinite(x).all() and x.shape == (len(group), len(quality.FEATURES))


@given(st.lists(st.text(alphabet="ab c\n\t|#é\x0b\x1c", max_size=60), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_statistics(group):
    check(group)
    check([None, *group, "", "\n\n"])


def test_odd(odd):
    check([r.text for r in odd.collect()])


def test_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 3))
    y = (x[:, 0] + 0.05 * np.sin(20 * x[:, 0]) + 0.2 * x[:, 1] + rng.normal(0, 0.05, 3000) < 0.6).astype(float)
    trees = boosting.fit(x, y, [-1, 0, 0])
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.85
    for row in x[:50]:
        grid = np.repeat(row[None], 200, axis=0)
        grid[:, 0] = np.linspace(0, 1, 200)
        assert (np.diff(trees.margin(grid)) <= 1e-12).all()


def test_one_class_or_none():
    x = np.zeros((3, 2))
    assert boosting.fit(x, np.ones(3)).score(x).min() > 0.99
    assert boosting.fit(x, np.zeros(3)).score(x).max() < 0.01
    assert boosting.fit(x[:0], np.zeros(0)).score(x).min() > 0.99


def test_flat_arrays_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(400, 4))
    trees = boosting.fit(x, (x[:, 0] * x[:, 1] > 0.2).astype(float), trees=7)
    for i in range(0, 400, 37):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if x[i, trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        assert abs(total - trees.margin(x)[i]) < 1e-12


def test_held_out_accuracy(spark, odd):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.fit(docs, labels.where("doc_id % 3 != 0"))
    rows = quality.judge(docs, trees).withColumnRenamed("quality", "score").join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert len(rows) > 100
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows]) > 0.95
    out = quality.judge(odd, trees).collect()
    assert len(out) == odd.count() and not any(r.kept for r in out if r.n_words < 50)
    kept = quality.keep_good(odd, trees)
    assert kept.columns == odd.columns
    assert quality.judge(odd.limit(0), trees).count() == 0
    empty = quality.fit(docs, labels.limit(0))
    assert quality.judge(docs, empty).where("kept = base_failed").count() == 0

"""Counts of rows within a distance against all pairs."""

import numpy as np
import pytest
from helpers import frame
from pyspark.sql import functions as F

from kantele import queries
from kantele.functions.kernels import all_within, none_within, squared_gaps
from kantele.operators.neighbors import counts_within, farthest
from kantele.sources.points import prepared


def counted(x, delta):
    gaps = sum((x[:, d, None] - x[:, d]) * (x[:, d, None] - x[:, d]) for d in range(x.shape[1]))
    return (np.sqrt(gaps) <= delta).sum(axis=1).tolist()


def test_many_copies_in_reach(spark):
    """100,000 rows whose pairs in reach are some 4,400 million."""
    df = spark.range(100_000).select(F.col("id").alias("row_id"), (F.col("id") % 1000).cast("double").alias("x"))
    found = counts_within(prepared(df, ["x"]), 250.0).select((F.col("row_id") % 1000).alias("x"), "n").groupBy("x").agg(F.min("n"), F.max("n"), F.count("*")).collect()
    expected = {v: 100 * (min(v + 250, 999) - max(v - 250, 0) + 1) for v in range(1000)}
    assert {r[0]: tuple(r[1:]) for r in found} == {v: (n, n, 100) for v, n in expected.items()}


@pytest.mark.parametrize("width,delta", [(1, 0.3), (2, 0.0), (2, 0.5), (2, 100.0), (7, 2.5)])
def test_counts_equal_all_pairs(spark, width, delta):
    """A grid by tenths, so that many pairs lie at delta but for rounding, with copies, over several tiles."""
    x = np.random.default_rng(3).integers(-12, 12, (4500, width)) / 10 + 0.1
    df, names = frame(spark, x, 2)
    found = {r["row_id"]: r["n"] for r in counts_within(prepared(df, names), delta).collect()}
    assert [found[i] for i in range(len(x))] == counted(x, delta)


def test_ids_of_texts_and_of_several_rows(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 1.0), ("c", 9.0)], "name string, v double")
    found = counts_within(prepared(df, ["v"], "name"), 1.0)
    assert sorted(map(tuple, found.collect())) == [("a", 3), ("a", 3), ("b", 3), ("c", 1)]
    assert counts_within(prepared(df.where("name = 'c'"), ["v"], "name"), 0.0).collect() == [("c", 1)]


def test_boxes_agree_with_rounded_distances():
    rng = np.random.default_rng(1)
    for delta in (0.0, 1e-200, 0.1, 0.3, 1.05, 1e3, 1e160):
        limit = farthest(delta)
        assert np.sqrt(limit) <= delta
        assert limit == np.finfo(float).max or np.sqrt(np.nextafter(limit, np.inf)) > delta
    for _ in range(300):
        a, b = rng.integers(-9, 9, (2, 5, 2)) / 10
        gaps, limit = squared_gaps(a, b), farthest(rng.integers(0, 15) / 10)
        box = a.min(axis=0)[None], a.max(axis=0)[None], b.min(axis=0)[None], b.max(axis=0)[None], limit
        assert not all_within(*box)[0, 0] or (gaps <= limit).all()
        assert not none_within(*box)[0, 0] or (gaps > limit).all()


def test_query_joins_no_pairs(spark):
    """A join of pairs of rows grows with their square."""
    found = queries.neighbour_counts(spark, "/root/testdata/sf0.001")
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()

"""Clusterings against plain loops, and their invariants."""

import numpy as np
import pytest
from helpers import blobs, collected, distances, frame, means, train

import kantele
from kantele import apply, steps

START = [[-0.6, 1.4], [2.9, 0.3], [1.1, 5.2]]
CASES = [
    ("kmeans", {}), ("fcm", {"m": 2.0}), ("fcm", {"m": 1.3}), ("fcm", {"m": 40.0}), ("efcm", {"tau": 0.7}),
    ("rcm", {"alpha": 1.3, "beta": 0.4, "p": 1.0}), ("rcm", {"alpha": 1.2, "beta": 0.5, "p": 2.5}),
]


@pytest.mark.parametrize("name,params", CASES)
def test_equals_a_plain_loop(spark, name, params):
    x = blobs()
    df, names = frame(spark, x)
    found = getattr(kantele, name)(df, 3, features=names, init=START, max_iter=4, **params)
    v, u, history = train(name, x, np.array(START), found.n_iter, **params)
    assert np.allclose(found.centers, v, atol=1e-9)
    assert np.allclose(found.history, history if name != "rcm" else [], rtol=1e-9)
    if name == "kmeans":
        (labels,) = collected(found, ["label"])
    else:
        labels, held = collected(found, ["label", "membership"])
        assert np.allclose(held, u, atol=1e-9) and np.allclose(held.sum(axis=1), 1)
    assert (labels == u.argmax(axis=1)).all()


@pytest.mark.parametrize("name,params", CASES)
def test_apply(spark, name, params):
    x = blobs()
    df, names = frame(spark, x)
    found = getattr(apply, name)(df, START, features=names, **params)
    _, u, history = train(name, x, np.array(START), 1, **params)
    assert (found.centers == np.array(START)).all() and found.stop_reason == "schedule" and found.n_iter == 1
    assert np.allclose(found.history, history if name != "rcm" else [], rtol=1e-9)
    assert (collected(found, ["label"])[0] == u.argmax(axis=1)).all()
    if name != "kmeans":
        assert np.allclose(collected(found, ["membership"])[0], u, atol=1e-9)


def rough(x, v, delta):
    d = np.sqrt(distances(x, x))
    near = d <= delta
    nearest = np.eye(len(v))[distances(x, v).argmin(axis=1)]
    return near @ nearest / near.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("delta", [0.0, 0.7, 3.0])
def test_rmcm(spark, delta):
    x = np.vstack([blobs(n=20), blobs(n=20)[:3]])
    df, names = frame(spark, x)
    found = kantele.rmcm(df, 3, delta=delta, features=names, init=START, max_iter=3)
    v = np.array(START)
    for _ in range(found.n_iter):
        u = rough(x, v, delta)
        v = means(x, u, v)
    assert np.allclose(found.centers, v, atol=1e-9)
    labels, held = collected(found, ["label", "membership"])
    assert np.allclose(held, u, atol=1e-12)
    assert (labels == held.argmax(axis=1)).all()
    if delta == 0.0:
        plain = kantele.kmeans(df, 3, features=names, init=START, max_iter=3)
        assert np.allclose(plain.centers, found.centers, atol=1e-9)
    given = apply.rmcm(df, START, delta=delta, features=names)
    assert np.allclose(collected(given, ["membership"])[0], rough(x, np.array(START), delta), atol=1e-12)
    with pytest.raises(ValueError, match="max_edges"):
        kantele.rmcm(df, 3, delta=3.0, features=names, init=START, max_edges=60)


def crowded():
    """5,000 rows, of whose 25 million pairs over 10 million lie within a distance of 2; with their memberships of START."""
    x = np.random.default_rng(5).normal(0, 1.2, (5000, 2)).round(2)
    gaps = x[:, None, :] - x
    near = np.sqrt(gaps[..., 0] * gaps[..., 0] + gaps[..., 1] * gaps[..., 1]) <= 2.0
    assert near.sum() > 10_000_000
    return x, near


def shares_near(x, near, v):
    own = np.eye(len(v))[distances(x, v).argmin(axis=1)]
    return near.astype(float) @ own / near.sum(axis=1, keepdims=True)


def test_apply_rmcm_past_ten_million_edges(spark):
    x, near = crowded()
    df, names = frame(spark, x)
    labels, held = collected(apply.rmcm(df, START, delta=2.0, features=names), ["label", "membership"])
    expected = shares_near(x, near, np.array(START))
    assert np.allclose(held, expected, atol=1e-12) and (labels == held.argmax(axis=1)).all()
    with pytest.raises(ValueError, match="max_edges"):
        apply.rmcm(df, START, delta=2.0, features=names, max_edges=int(near.sum()) - 1)
    assert apply.rmcm(df, START, delta=2.0, features=names, max_edges=int(near.sum())).assignments.count() == 5000


def test_rmcm_past_ten_million_edges(spark):
    x, near = crowded()
    df, names = frame(spark, x)
    found = kantele.rmcm(df, 3, delta=2.0, features=names, init=START, max_iter=2)
    v = np.array(START)
    for _ in range(2):
        u = shares_near(x, near, v)
        v = means(x, u, v)
    assert found.n_iter == 2 and np.allclose(found.centers, v, atol=1e-9)
    assert np.allclose(collected(found, ["membership"])[0], u, atol=1e-12)


def test_rmcm_by_hand(spark):
    df, names = frame(spark, np.array([[7.0], [12.0], [7.0]]), 1)
    pair = df.where("row_id < 2")
    found = apply.rmcm(pair, [[5.0], [14.0]], delta=6.0, features=names)
    assert collected(found, ["membership"])[0].tolist() == [[0.5, 0.5], [0.5, 0.5]]
    alone = apply.rmcm(df.where("row_id = 2"), [[5.0], [14.0]], delta=6.0, features=names)
    assert collected(alone, ["membership"])[0].tolist() == [[1.0, 0.0]]


def test_fixed_point_and_ties(spark):
    x = blobs()
    df, names = frame(spark, x, 5)
    found = kantele.kmeans(df, 3, features=names, init=START)
    assert found.stop_reason == "tol"
    again = kantele.kmeans(df, 3, features=names, init=found.centers)
    assert again.n_iter == 1 and np.array_equal(again.centers, found.centers)
    assert (np.diff(found.history) <= 1e-9).all()
    tie, names = frame(spark, np.array([[0.0], [1.0], [2.0]]), 1)
    assert collected(apply.kmeans(tie, [[0.0], [2.0]], features=names), ["label"])[0].tolist() == [0, 0, 1]


def test_empty_and_coincident_centers(spark):
    df, names = frame(spark, np.array([[0.0, 0.0], [0.0, 0.0], [1.0, 1.0], [1.0, 1.0]]), 2)
    found = kantele.kmeans(df, 3, features=names, init=[[0.0, 0.0], [1.0, 1.0], [50.0, 50.0]])
    assert found.centers.tolist() == [[0.0, 0.0], [1.0, 1.0], [50.0, 50.0]]
    held = collected(apply.fcm(df, [[0.0, 0.0], [0.0, 0.0], [1.0, 1.0]], m=2.0, features=names), ["membership"])[0]
    assert np.allclose(held[0], [0.5, 0.5, 0.0])


def test_reductions_to_kmeans(spark):
    x = blobs()
    df, names = frame(spark, x)
    plain = kantele.kmeans(df, 3, features=names, init=START)
    for found in (
        kantele.rcm(df, 3, features=names, init=START, alpha=1.0), kantele.efcm(df, 3, features=names, init=START, tau=1e-9),
        kantele.fcm(df, 3, features=names, init=START, m=1 + 1e-6),
    ):
        assert np.allclose(found.centers, plain.centers, atol=1e-6)


def test_array_column_and_translation(spark):
    from pyspark.sql import functions as F

    x = blobs()
    df, names = frame(spark, x)
    whole = df.select("row_id", F.array(*names).cast("array<float>").cast("array<double>").alias("v"))
    shifted, _ = frame(spark, x + 100)
    a = kantele.efcm(whole, 3, features="v", init=START, max_iter=3)
    b = kantele.efcm(shifted, 3, features=names, init=np.array(START) + 100, max_iter=3)
    assert np.allclose(a.centers + 100, b.centers, atol=1e-4)


def test_seeding_finds_separate_blobs(spark):
    rng = np.random.default_rng(0)
    centers = rng.uniform(-50, 50, (6, 4))
    x = np.vstack([rng.normal(c, 0.3, (50, 4)) for c in centers])
    df, names = frame(spark, x, 4)
    hits = 0
    for seed in range(4):
        found = kantele.kmeans(df, 6, features=names, seed=seed)
        hits += np.sqrt(distances(centers, found.centers).min(axis=1)).max() < 1
    assert hits >= 3
    one = [kantele.kmeans(df, 6, features=names, seed=9, max_iter=1).centers for _ in range(2)]
    assert np.array_equal(*one)
    same, names = frame(spark, np.zeros((5, 2)), 2)
    assert kantele.kmeans(same, 3, features=names, seed=1).centers.tolist() == [[0.0, 0.0]] * 3


def test_checks(spark):
    df, names = frame(spark, blobs())
    bad = [
        (ValueError, {"k": 0}), (ValueError, {"k": True}), (ValueError, {"k": 1000}), (ValueError, {"init": "random"}), (ValueError, {"init": [[1.0]]}),
        (ValueError, {"seed": -1}), (ValueError, {"max_iter": 0}), (TypeError, {"init": [["a", "b"]] * 3}), (TypeError, {"init": [[True, False]] * 3}),
    ]
    for kind, change in bad:
        args = {"k": 3, **change}
        with pytest.raises(kind):
            kantele.kmeans(df, args.pop("k"), features=names, **args)
    for change in ({"m": 1.0}, {"m": float("nan")}, {"tol": -1.0}):
        with pytest.raises(ValueError):
            kantele.fcm(df, 3, features=names, **change)
    with pytest.raises(ValueError):
        kantele.efcm(df, 3, features=names, tau=0.0)
    with pytest.raises(ValueError, match="tau"):
        kantele.efcm(df, 3, features=names, tau=1e308, init=START)
    with pytest.raises(ValueError):
        kantele.rcm(df, 3, features=names, alpha=0.5)
    with pytest.raises(TypeError):
        apply.fcm(df, START, features=names)


def test_faulty_rows(spark):
    make = lambda rows, kind="double": spark.createDataFrame(rows, f"row_id long, a {kind}, b {kind}")
    cases = [
        (TypeError, make([(1, "x", "y")], "string")), (TypeError, make([(1, True, False)], "boolean")), (TypeError, make([(1, 1.0, None)])),
        (TypeError, make([(None, 1.0, 2.0)])), (ValueError, make([(1, 1.0, float("nan"))])), (ValueError, make([(1, 1.0, float("inf"))])),
        (ValueError, make([])), (ValueError, make([(1, 1e200, 0.0)])), (ValueError, make([(1, 0.0, 0.0), (2, 1e-170, 0.0)])),
    ]
    for kind, df in cases:
        with pytest.raises(kind):
            apply.kmeans(df, [[0.0, 0.0]], features=["a", "b"])
    ragged = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "row_id long, v array<double>")
    with pytest.raises(ValueError):
        apply.kmeans(ragged, [[0.0, 0.0]], features="v")


def test_collapse_past_the_threshold(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 1.0, (50, 8)) for c in rng.uniform(-3, 3, (4, 8))])
    df, names = frame(spark, x)
    covariance = np.cov(x.T, bias=True)
    tau = 2 * np.linalg.eigvalsh(covariance).max()
    found = kantele.efcm(df, 4, features=names, tau=1.5 * tau, init=x.mean(axis=0) + rng.normal(0, 1e-3, (4, 8)), max_iter=60)
    assert np.abs(found.centers - x.mean(axis=0)).max() < 1e-2


def test_progress_snapshots(spark):
    df, names = frame(spark, blobs())
    run = steps.fcm(df, 3, features=names, init=START, max_iter=3)
    seen = [progress.result() for progress in run]
    for i, result in enumerate(seen):
        alone = kantele.fcm(df, 3, features=names, init=START, max_iter=i + 1)
        assert np.array_equal(alone.centers, result.centers) and len(result.history) == i + 1
    assert [r.stop_reason for r in seen] == [None, None, "limit"]


@pytest.mark.parametrize("params", [{}, {"m": 2.3}, {"tau": 0.8}])
def test_sites_together_update_like_all_rows(spark, params):
    df, names = frame(spark, blobs() + 50)
    start = np.array(START) + 50
    parts = [kantele.partial_update(df.where(f"row_id % 3 = {site}"), start, features=names, **params) for site in range(3)]
    centers, objective = kantele.merged_update(parts, start)
    whole = kantele.fcm if "m" in params else kantele.efcm if "tau" in params else kantele.kmeans
    found = whole(df, 3, features=names, init=start, max_iter=1, **params)
    assert np.allclose(centers, found.centers, atol=1e-9) and objective == pytest.approx(found.history[0])
    for bad in ([], [*parts, kantele.partial_update(df, start + 1, features=names, **params)]):
        with pytest.raises(ValueError):
            kantele.merged_update(bad, start)
    with pytest.raises(ValueError):
        kantele.partial_update(df, start, features=names, m=2.0, tau=1.0)

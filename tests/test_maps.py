"""Maps against plain loops."""

import numpy as np
import pytest
from helpers import blobs, collected, distances, frame, means

import kantele
from kantele import apply

UNITS = np.array([[r, c] for r in range(4) for c in range(3)], float)
START = np.array([[x, y] for x in np.linspace(-2, 4.5, 4) for y in np.linspace(-1.5, 7, 3)])


def schedule(a, b, f):
    return a ** (1 - f) * b**f


def near(units, best, s):
    return np.exp(-0.5 * (((units - units[best]) / s) ** 2).sum(axis=1))


def batch(x, w, units, epochs, s0, s1):
    for t in range(epochs):
        s = schedule(s0, s1, t / (epochs - 1)) if epochs > 1 else s0
        h = np.array([near(units, b, s) for b in distances(x, w).argmin(axis=1)])
        w = means(x, h, w)
    return w


def online(x, w, units, epochs, s0, s1, l0, l1):
    w, n = w.copy(), len(x)
    for t in range(epochs * n):
        f = t / (epochs * n - 1)
        row = x[t % n]
        best = ((row - w) ** 2).sum(axis=1).argmin()
        w += schedule(l0, l1, f) * near(units, best, schedule(s0, s1, f))[:, None] * (row - w)
    return w


def olp(x, w, units, lam, gamma, steps, still=False):
    p, history, changes = None, [], []
    for _ in range(steps):
        cost = distances(x, w)
        if p is not None:
            cost = cost + gamma * distances(p @ units, units)
        e = np.exp(-(cost - cost.min(axis=1, keepdims=True)) / lam)
        new = e / e.sum(axis=1, keepdims=True)
        history.append((cost.min(axis=1) - lam * np.log(e.sum(axis=1))).sum())
        changes.append(None if p is None else np.abs(new - p).max())
        p = new
        if not still:
            w = means(x, p, w)
    return w, p, history, changes


@pytest.mark.parametrize("epochs", [1, 4])
def test_batch_som(spark, epochs):
    x = blobs()
    df, names = frame(spark, x)
    found = kantele.batch_som(df, (4, 3), features=names, epochs=epochs, init=START)
    w = batch(x, START, UNITS, epochs, 1.5, 0.5)
    assert np.allclose(found.centers, w, atol=1e-9) and found.stop_reason == "schedule"
    label, place = collected(found, ["label", "embedding"])
    assert (label == distances(x, w).argmin(axis=1)).all() and (place == UNITS[label]).all()
    assert (found.unit_coordinates == UNITS).all() and len(found.history) == 0


def test_online_som(spark):
    x = blobs(n=15)
    df, names = frame(spark, x)
    found = kantele.som(df, (4, 3), features=names, epochs=2, shuffle=False, init=START)
    assert np.allclose(found.centers, online(x, START, UNITS, 2, 1.5, 0.5, 0.5, 0.01), atol=1e-9)
    odd = np.random.default_rng(17).normal(size=(7, 3)) * 1.7 + 0.4
    given = kantele.som(df, odd, features=names, epochs=1, sigma=1.0, shuffle=False, init=START[:7])
    assert np.allclose(given.centers, online(x, START[:7], odd, 1, 1.0, 0.5, 0.5, 0.01), atol=1e-9)
    a, b, c = (kantele.som(df, (4, 3), features=names, epochs=1, seed=s).centers for s in (1, 1, 2))
    assert np.array_equal(a, b) and not np.array_equal(a, c)


def test_som_olp_and_its_application(spark):
    x = blobs()
    df, names = frame(spark, x)
    found = kantele.som_olp(df, (4, 3), features=names, lam=1.3, gamma=0.4, init=START, max_iter=5)
    w, p, history, _ = olp(x, START, UNITS, 1.3, 0.4, 5)
    assert np.allclose(found.centers, w, atol=1e-9) and np.allclose(found.history, history, rtol=1e-9) and found.stop_reason == "limit"
    label, held, place = collected(found, ["label", "membership", "embedding"])
    assert np.allclose(held, p, atol=1e-9) and np.allclose(place, p @ UNITS, atol=1e-9) and (label == p.argmax(axis=1)).all()
    given = apply.som_olp(df, w, (4, 3), lam=1.3, gamma=0.4, features=names, tol=1e-3)
    _, p, history, changes = olp(x, w, UNITS, 1.3, 0.4, given.n_iter, still=True)
    assert np.array_equal(given.centers, w) and given.stop_reason == "tol"
    assert changes[-1] <= 1e-3 and all(c is None or c > 1e-3 for c in changes[:-1])
    assert np.allclose(collected(given, ["membership"])[0], p, atol=1e-9) and np.allclose(given.history, history, rtol=1e-9)
    assert (np.diff(given.history[1:]) <= 1e-9).all()
    limited = apply.som_olp(df, w, (4, 3), lam=1.3, gamma=0.4, features=names, tol=0.0, max_iter=2)
    assert limited.n_iter == 2


def test_latent_positions_go_on_with_the_same_rows(spark):
    x = blobs()
    df, names = frame(spark, x)
    settings = {"lam": 1.3, "gamma": 0.4, "features": names, "init": START, "max_iter": 3}
    plain = kantele.som_olp(df, (4, 3), **settings)
    run = kantele.steps.som_olp(df, (4, 3), **settings)
    next(run)
    run.send(df)
    with pytest.raises(StopIteration) as end:
        run.send(df)
        run.send(None)
    assert np.allclose(end.value.value.centers, plain.centers, atol=1e-9)
    run = kantele.steps.som_olp(df, (4, 3), **settings)
    next(run)
    fewer = run.send(df.where("row_id < 100")).result()
    w, _, _, _ = olp(x, START, UNITS, 1.3, 0.4, 1)
    assert np.allclose(fewer.centers, olp(x[:100], w, UNITS, 1.3, 0.4, 1)[0], atol=1e-9)
    # As many rows under other ids go on by their place.
    run = kantele.steps.som_olp(df, (4, 3), **settings)
    next(run)
    other, _ = frame(spark, x, first=1000)
    run.send(other)
    with pytest.raises(StopIteration) as end:
        run.send(other.repartition(3))
        run.send(None)
    assert np.allclose(end.value.value.centers, plain.centers, atol=1e-9)


def test_older_latent_rows_are_let_go(spark):
    """However many iterations, few frames stay held."""
    df, names = frame(spark, blobs())
    held = spark.sparkContext._jsc.getPersistentRDDs
    before = len(held())
    run = kantele.steps.som_olp(df, (4, 3), lam=1.3, gamma=0.4, features=names, init=START, max_iter=9)
    counts = [len(held()) - before for _ in run]
    assert max(counts) <= 5 and counts[-1] <= counts[3] + 1


def test_apply_som(spark):
    x = blobs()
    df, names = frame(spark, x)
    found = apply.som(df, START, (4, 3), features=names)
    label, place = collected(found, ["label", "embedding"])
    assert (label == distances(x, START).argmin(axis=1)).all() and (place == UNITS[label]).all()
    assert apply.batch_som is apply.som
    with pytest.raises(ValueError, match="unit"):
        apply.som(df, START[:5], (4, 3), features=names)


def test_principal_start(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3)) * [3, 1, 0.2] + 5
    df, names = frame(spark, x)
    run = kantele.steps.batch_som(df, (3, 2), features=names, epochs=1, sigma=1e-9)
    next(run)
    from kantele.operators.maps import principal_start, unit_coordinates
    from kantele.sources.points import prepared

    units = unit_coordinates((3, 2))
    start = principal_start(prepared(df, names), units, 2.0)
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / len(c))
    axes = [vectors[:, -1], vectors[:, -2]]
    assert np.allclose(kantele.operators.maps.covariance(prepared(df, names)), c.T @ c / len(c))
    axes = [a * np.sign(a[np.flatnonzero(np.abs(a) > 1e-6 * np.abs(a).max())[0]]) for a in axes]
    spread = (units - units.mean(axis=0)) / np.abs(units - units.mean(axis=0)).max(axis=0)
    assert np.allclose(start, sum(np.outer(spread[:, i] * 2 * np.sqrt(values[-1 - i]), axes[i]) for i in range(2)), atol=1e-9)
    few = rng.normal(size=(6, 20)) * np.linspace(3, 0.1, 20)
    wide, names = frame(spark, few)
    start = principal_start(prepared(wide, names), units, 1.0)
    c = few - few.mean(axis=0)
    # Prototypes lie in the plane of the two leading axes, at one deviation at most along each.
    values, vectors = np.linalg.eigh(c.T @ c / 6)
    along = start @ vectors[:, -2:]
    assert np.allclose(along @ vectors[:, -2:].T, start) and np.allclose(np.abs(along).max(axis=0), np.sqrt(values[-2:]))
    assert kantele.batch_som(wide, (2, 2), features=names, epochs=2).centers.shape == (4, 20)


def test_extremes_and_checks(spark):
    df, names = frame(spark, blobs())
    tiny = kantele.batch_som(df, (4, 3), features=names, epochs=2, sigma=1e-300, sigma_end=1e-300, init=START)
    assert np.isfinite(tiny.centers).all()
    hard = kantele.som_olp(df, (4, 3), features=names, lam=1e-300, gamma=0.0, init=START, max_iter=2)
    assert set(np.unique(collected(hard, ["membership"])[0])) == {0.0, 1.0}
    for change in ({"lam": 0.0}, {"gamma": -1.0}, {"gamma": 1e300}, {"lam": 1e308}, {"init": "random"}, {"init": START[:2]}, {"pca_scale": 0.0}):
        with pytest.raises(ValueError):
            kantele.som_olp(df, (4, 3), **{"lam": 1.0, "gamma": 1.0, "features": names, **change})
    for change in ({"epochs": 0}, {"sigma": 0.0}, {"lr": 1.5}, {"shuffle": 1}, {"grid": (0, 2)}, {"grid": (1, 2, 3)}, {"grid": [[True, False]]}):
        with pytest.raises((ValueError, TypeError)):
            kantele.som(df, **{"grid": (2, 2), "features": names, **change})

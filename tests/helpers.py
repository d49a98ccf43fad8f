"""Plain loops that the methods must equal, and small data."""

import numpy as np


def blobs(seed=11, n=40, spread=0.7):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, spread, (n, 2)) for c in ((-1, 2), (3.5, -0.5), (0.5, 6.5))])


def frame(spark, x, parts=3, first=0):
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(first + i, *map(float, row)) for i, row in enumerate(x)]
    schema = "row_id long, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema).repartition(parts), names


def distances(x, v):
    return ((x[:, None, :] - v[None, :, :]) ** 2).sum(axis=2)


def memberships(method, d, **p):
    """(U, objective or None) row by row."""
    u, value = np.zeros_like(d), 0.0
    for i, row in enumerate(d):
        if method == "kmeans":
            u[i, np.flatnonzero(row == row.min())[0]] = 1
            value += row.min()
        elif method == "fcm":
            row = np.maximum(row, np.finfo(float).tiny)
            r = (row.min() / row) ** (1 / (p["m"] - 1))
            u[i] = r / r.sum()
            value += (u[i] ** p["m"] * row).sum()
        elif method == "efcm":
            e = np.exp(-(row - row.min()) / p["tau"])
            u[i] = e / e.sum()
            logs = np.where(u[i] > 0, np.log(np.maximum(u[i], 1e-300)), 0)
            value += (u[i] * row).sum() + p["tau"] * (u[i] * logs).sum()
        else:
            s = np.sqrt(row)
            reach = ((p["alpha"] * s.min()) ** p["p"] + p["beta"] ** p["p"]) ** (1 / p["p"])
            u[i] = s <= reach * (1 + 1e-15)
            u[i] /= u[i].sum()
            value = None if i == len(d) - 1 else 0.0
    return u, value


def means(x, w, v):
    out = v.copy()
    for c in range(len(v)):
        if w[:, c].sum() > 0:
            out[c] = (w[:, c, None] * x).sum(axis=0) / w[:, c].sum()
    return out


def train(method, x, v, steps, **p):
    """Centers, last memberships and objectives after a number of steps."""
    history = []
    for _ in range(steps):
        u, value = memberships(method, distances(x, v), **p)
        if value is not None:
            history.append(value)
        w = (u / np.maximum(u.max(axis=0), 1e-300)) ** p["m"] if method == "fcm" else u
        v = means(x, w, v)
    return v, u, history


def collected(result, names):
    rows = sorted(result.assignments.collect(), key=lambda r: r.row_id)
    return [np.array([r[n] for r in rows]) for n in names]

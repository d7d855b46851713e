"""Kernel machines against dense kernels and plain solvers."""

import numpy as np
import pytest

from originlens.operators import kernels, metrics, models


def rings(spark, n, seed):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    a, r = rng.uniform(0, 2 * np.pi, n), np.where(y == 1, 1.0, 2.5) + rng.normal(scale=0.15, size=n)
    x = np.stack([r * np.cos(a), r * np.sin(a)], axis=1)
    return x, y, spark.createDataFrame([(i, int(t), [float(v) for v in p]) for i, (p, t) in enumerate(zip(x, y))], "id int, y int, features array<double>")


def dense_svc(x, y, gamma, c, rounds=300):
    """Dual coordinate ascent with the exact kernel; the intercept is a constant feature."""
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2)) + 1.0
    s = 2.0 * y - 1.0
    a = np.zeros(len(y))
    for _ in range(rounds):
        for i in range(len(y)):
            a[i] = np.clip(a[i] + (1 - s[i] * (k[i] @ (a * s))) / k[i, i], 0, c)
    return a * s


def test_features_approach_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3))
    z = kernels.FourierFeatures.make(3, 0.4, 20_000).map(x)
    assert np.abs(z @ z.T - np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(axis=2))).max() < 0.05


def test_svc_separates_rings(spark):
    x, y, train = rings(spark, 200, 1)
    xt, yt, test = rings(spark, 200, 2)
    machine = kernels.fit_svc(train)
    scored = machine.score(test).orderBy("id").toPandas()
    assert scored.score.between(0, 1).all() and scored.columns.tolist() == ["id", "y", "features", "score"]
    assert metrics.roc_auc(machine.score(test)).first().roc_auc > 0.97
    linear = models.fit_classifier("linear_svc", train).score(test)
    assert metrics.roc_auc(linear).first().roc_auc < 0.75
    n, dims, gamma = kernels.scale_gamma(train, "features")
    assert (n, dims) == (200, 2) and gamma == pytest.approx(1 / (2 * x.var()))
    dense = np.exp(-gamma * ((xt[:, None] - x[None]) ** 2).sum(axis=2)) + 1.0
    want = dense @ dense_svc(x, y, gamma, 1.0) > 0
    assert ((scored.score > 0.5).to_numpy() == want).mean() > 0.95


def test_svr_reaches_the_loss_of_a_plain_solver(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, size=(150, 2))
    y = np.sin(2 * x[:, 0]) + 0.3 * x[:, 1] + rng.normal(scale=0.2, size=150)
    train = spark.createDataFrame([(i, float(t), [float(v) for v in p]) for i, (p, t) in enumerate(zip(x, y))], "id int, y double, features array<double>")
    machine = kernels.fit_svr(train, components=20)
    z = machine.features.map(x)

    def loss(w, b):
        return w @ w / 2 + np.maximum(np.abs(z @ w + b - y) - 0.1, 0).sum()

    # subgradient steps of falling size, the best point counts
    w, b, best = np.zeros(20), 0.0, np.inf
    for t in range(40_000):
        off = z @ w + b - y
        s = np.sign(off) * (np.abs(off) > 0.1)
        size = 0.05 / np.sqrt(1 + t)
        w, b = w - size * (w + z.T @ s), b - size * s.sum()
        best = min(best, loss(w, b))
    assert loss(machine.weights, machine.intercept) <= 1.01 * best
    g = kernels.svr_gradient(machine, train).collect()
    assert len(g) == 21 and max(abs(r.gradient) for r in g) < 1e-3
    got = machine.score(train).orderBy("id").toPandas().score.to_numpy()
    assert got == pytest.approx(z @ machine.weights + machine.intercept)


def test_hard_inputs(spark):
    same = spark.createDataFrame([(i, i % 2, [1.0, 1.0]) for i in range(40)], "id int, y int, features array<double>")
    assert {round(r.score, 2) for r in kernels.fit_svc(same, components=8).score(same).collect()} == {0.5}
    assert kernels.fit_svr(same, components=8).score(same.limit(0)).count() == 0
    with pytest.raises(ValueError):
        kernels.fit_svr(same.limit(0))


def test_minimise_a_bowl():
    a = np.diag(np.geomspace(1, 1000, 12))
    x = kernels.minimise(lambda x: (0.5 * (x - 1) @ a @ (x - 1), a @ (x - 1)), np.zeros(12))
    assert x == pytest.approx(np.ones(12), abs=1e-4)


def test_svr_passes_read_rows_and_map_them_in_slices(spark, monkeypatch):
    stored, store = [], kernels.materialise
    monkeypatch.setattr(kernels, "materialise", lambda df, name: stored.append(store(df, name)) or stored[-1])
    monkeypatch.setattr(kernels, "SLICE", 7)
    monkeypatch.setattr(kernels, "minimise", lambda evaluate, w, tolerance: w + 0 * evaluate(w)[0])  # one pass
    _, _, train = rings(spark, 40, 5)
    machine = kernels.fit_svr(train, components=8)
    assert {len(r.x) for r in stored[0].collect()} == {2}  # two features, not eight mapped ones
    f, w = machine.features, np.arange(9.0)
    x, y = (np.array([r[c] for r in stored[0].collect()]) for c in ("x", "y"))
    loss, _, n = kernels.tube_loss(stored[0], f, w, 0.1, 0.01)
    off = np.abs(f.map(x) @ w[:-1] + w[-1] - y) - 0.1
    assert n == 40 and loss == pytest.approx(kernels._bend(off, 0.01)[0].sum())
    ragged = spark.createDataFrame([(0, 1.0, [1.0]), (1, 0.0, [1.0, 2.0])], "id int, y double, features array<double>")
    with pytest.raises(Exception):  # noqa: B017
        machine.score(ragged).collect()

"""Learners trained by sums over rows: against direct minimisation, numeric gradients, and a stop by themselves."""

import numpy as np
import pytest

from flowloom.operators import models as md
from flowloom.operators import trained


def rows(spark, n=600, classes=3, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    centres = rng.normal(0, 3, (classes, 4))
    x = centres[y] + rng.normal(0, spread, (n, 4))
    return spark.createDataFrame([([float(v) for v in r], int(c)) for r, c in zip(x, y)], "vector array<double>, y int"), x, y


def test_newton_reaches_the_minimum(spark):
    """Least squares for two problems at once."""
    df, x, y = rows(spark)
    data = df.selectExpr("vector", "y", "0 as fold")

    def terms(at, live):
        def partial(x, y, fold):
            out = {}
            for k in live.tolist():
                gap = x @ at[k] - (y == k)
                out[k] = np.concatenate([[gap @ gap], 2 * gap @ x, (2 * x.T @ x).ravel()])
            return out
        return partial

    got = trained._newton(data, np.zeros((2, 4)), terms, 20, np.zeros(4))
    for k in range(2):
        assert np.allclose(got[k], np.linalg.lstsq(x, (y == k).astype(float), rcond=None)[0], atol=1e-8)


def test_svm_of_all_folds_and_classes(spark):
    df, x, y = rows(spark, spread=1.5)
    model = md.fit_linear_svm(df, 3)
    assert len(model.folds) == 3 and all(len(f) == 3 for f in model.folds)
    got = md.predict(df, model).collect()
    assert np.mean([r.yhat == r.y for r in got]) > 0.85
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in got)
    # no small change of a fold's coefficients makes its objective smaller
    fold = {tuple(r.vector): r.fold for r in df.selectExpr("vector", "cast(pmod(xxhash64(cast(%d as int), vector, y), 3) as int) as fold" % md.fv.SEED).collect()}
    at = np.array([fold[tuple(v)] for v in x.tolist()])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    part, label = (x[at != 0] - mean) / scale, y[at != 0]
    coef, bias, _, _ = model.folds[0][1]
    t = np.where(label == 1, 1.0, -1.0)
    share = np.where(t > 0, 0.5 / (t > 0).sum(), 0.5 / (t < 0).sum())

    def objective(w, b):
        return (share * np.maximum(0, 1 - t * (part @ w + b)) ** 2).sum() + 0.5 * 1e-4 * w @ w

    w, b = np.array(coef) * scale, bias + np.array(coef) @ mean
    rng = np.random.default_rng(1)
    assert all(objective(w, b) <= objective(w + d[:4], b + d[4]) + 1e-9 for d in rng.normal(0, 0.01, (50, 5)))


def test_svm_with_a_class_that_is_missing_in_a_fold(spark):
    df, _, _ = rows(spark, n=90)
    rare = spark.createDataFrame([([9.0, 9.0, 9.0, 9.0], 3)], df.schema)
    model = md.fit_linear_svm(df.unionByName(rare), 4)
    assert all(np.isfinite([*c, b, s, h]).all() for f in model.folds for c, b, s, h in f)


def test_perceptron_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(5)
    layers = [rng.normal(0, 0.5, s) for s in ((5, 6), (7, 4), (5, 3))]
    x, y = rng.normal(0, 1, (11, 4)), rng.integers(0, 3, 11)

    def loss():
        p = trained.forward(layers, x)[-1]
        return -np.log(p[np.arange(11), y]).mean() + 0.5 * 0.01 * sum((w[:-1] ** 2).sum() for w in layers)

    found = trained.gradients(layers, x, y, 0.01)
    for w, g in zip(layers, found):
        for i, j in ((0, 0), (w.shape[0] - 1, 1), (2, 2)):
            old = w[i, j]
            w[i, j] = old + 1e-6
            up = loss()
            w[i, j] = old - 1e-6
            down = loss()
            w[i, j] = old
            assert abs((up - down) / 2e-6 - g[i, j]) < 1e-6


def test_perceptron_learns_and_stops_by_itself(spark):
    df, _, _ = rows(spark, n=900, spread=0.7)
    model = md.fit_mlp(df, 3, patience=4)
    assert model.epochs < 100 and len(model.validation) == model.epochs + 1
    best = max(model.validation)
    assert best > 0.9 and all(v <= best + 1e-4 for v in model.validation[-4:])
    got = md.predict(df, model).collect()
    assert np.mean([r.yhat == r.y for r in got]) > 0.9
    again = md.fit_mlp(df, 3, patience=4)
    assert again.epochs == model.epochs


def test_no_rows(spark):
    df, _, _ = rows(spark, n=3)
    for fit in (md.fit_linear_svm, md.fit_mlp):
        with pytest.raises((ValueError, TypeError)):
            fit(df.limit(0), 3)

"""Random forest: cuts against exhaustive search, the same trees however rows are spread, learning, copies, empty input; the learners' queries fit on all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import forest
from flowloom.operators import models as md
from flowloom.plans import table_queries as tq


def rows(spark, n=900, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 2, (n, 5)), 2)
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 1)
    return spark.createDataFrame([([float(v) for v in r], int(c), 1.0) for r, c in zip(x, y)], "vector array<double>, y int, weight double"), x, y


def test_grow_cuts_like_exhaustive_search():
    rng = np.random.default_rng(2)
    bins, y, w = rng.integers(0, 8, (120, 3)).astype(np.uint8), rng.integers(0, 3, 120), rng.integers(1, 4, 120).astype(float)
    feature, edge, left, value = forest.grow(bins, y, w, 0, 1, 4, 8, 3, 3, 42)
    sums = lambda ix: np.bincount(y[ix], w[ix], 3)
    square = lambda ix: (sums(ix) ** 2).sum() / w[ix].sum()

    def walk(node, ix, level):
        cuts = {(f, e): (ix[bins[ix, f] <= e], ix[bins[ix, f] > e]) for f in range(3) for e in range(8)} if level else {}
        gains = {c: square(a) + square(b) - square(ix) for c, (a, b) in cuts.items() if len(a) and len(b)}
        best = max(gains.values(), default=0)
        if best <= 1e-9:
            assert feature[node] == -1 and np.allclose(value[left[node]], sums(ix) / w[ix].sum())
            return
        at = (feature[node], edge[node])
        assert gains[at] == pytest.approx(best)
        for child, part in zip((left[node], left[node] + 1), cuts[at]):
            walk(child, part, level - 1)

    walk(0, np.arange(120), 4)


def test_draws_are_poisson():
    key = np.random.default_rng(0).integers(-2**63, 2**63 - 1, 40_000)
    for n in (1, 3, 500):
        got = forest.draws(key, np.full(len(key), n), 7, 42)
        assert got.mean() == pytest.approx(n, rel=0.03) and got.var() == pytest.approx(n, rel=0.05)
    assert abs(np.corrcoef(forest.draws(key, np.ones(len(key), int), 1, 42), forest.draws(key, np.ones(len(key), int), 2, 42))[0, 1]) < 0.02


def test_same_trees_however_the_work_is_spread(spark):
    df, x, y = rows(spark)
    p = lambda model: np.array([r.probability for r in model.transform(df).orderBy("vector").collect()])
    one = p(forest.fit(df.coalesce(1), 3, 6, 6))
    other = p(forest.fit(df.repartition(5), 3, 6, 6, task_rows=60, group_rows=2000))
    assert np.allclose(one, other) and np.allclose(one.sum(axis=1), 1)
    assert np.allclose(one, p(forest.fit(df, 3, 6, 6, task_rows=0)))


def test_it_learns_and_takes_missing_values(spark, monkeypatch):
    monkeypatch.setattr(forest, "PASS_BYTES", 20_000)
    df, _, _ = rows(spark, 1500)
    held, _, _ = rows(spark, 500, seed=5)
    model = md.fit_random_forest(df.drop("weight"), 3, trees=30, depth=12)
    got = md.predict(held, model).collect()
    assert len(got) == 500 and np.mean([r.yhat == r.y for r in got]) > 0.85
    gone = df.withColumn("vector", F.transform("vector", lambda v, i: F.when((i == 3) & (v > 1), F.lit(None)).otherwise(v)))
    assert md.predict(gone, md.fit_random_forest(gone, 3, trees=3, depth=4)).count() == 1500
    with pytest.raises(ValueError):
        md.fit_random_forest(df.limit(0), 3)


def test_queries_fit_on_the_whole_train_part(spark, monkeypatch):
    """Every learner's query hands its fit all rows of the train part, however many."""
    n = tq.FIT_ROWS + 500
    df = spark.range(n).select((F.col("id") % 3).cast("int").alias("y"), F.array(F.col("id").cast("double")).alias("vector"), *[F.col("id").cast("double").alias(c) for c in tq.FEATURES])
    seen = {}

    class Chain:
        classes = ["a", "b", "c"]

    class Even:
        def transform(self, d):
            return d.withColumn("probability", F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)))

    def fit(name):
        def run(train, k, *more):
            seen.setdefault(name, []).append(train.count())
            return Even()
        return run

    monkeypatch.setattr(tq, "model_rows", lambda spark, sf_dir: (df, df.limit(30), Chain))
    for name in ("fit_random_forest", "fit_boosted_trees", "fit_mlp", "fit_linear_svm"):
        monkeypatch.setattr(md, name, fit(name))
        getattr(tq, name)(spark, "")
        assert seen.pop(name) == [n]
    tq.unseen_class_eval(spark, "")
    assert seen["fit_random_forest"] == [n - n // 3 - (n % 3 > 1), n - n // 3]


def test_perceptron_parts_stay_bounded(spark, monkeypatch):
    from flowloom.operators import trained

    monkeypatch.setattr(trained, "PART_ROWS", 100)
    df, _, _ = rows(spark, 1500)
    sizes = []
    monkeypatch.setattr(trained, "cut", lambda d, keep=trained.cut: sizes.append(d.rdd.getNumPartitions()) or keep(d))
    trained.fit_perceptron(df.select("vector", "y"), 3, (4,), 1, 1)
    assert sizes[-1] == 15

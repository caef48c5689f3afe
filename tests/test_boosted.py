"""Boosted trees of all classes: cuts against exhaustive search, the same trees however rows are spread, scoring by SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import boosted
from flowloom.operators import models as md


def rows(spark, n=900, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 2, (n, 5)), 2)
    y = ((x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 1)) % classes  # not linear
    return spark.createDataFrame([([float(v) for v in r], int(c), 1.0) for r, c in zip(x, y)], "vector array<double>, y int, weight double"), x, y


def fit(df, classes=3, rounds=3, depth=3, subsample=1.0, columns=1.0, **more):
    return boosted.fit(df, classes, rounds, depth, 0.1, subsample, columns, **more)


def by_hand(x, y, classes, rounds, depth, edges, l2=1.0):
    """Margins of plain boosting, every cut found by trying all of them."""
    margin = np.zeros((len(x), classes))

    def tree(ix, g, h, level):
        leaf = -0.1 * g[ix].sum() / (h[ix].sum() + l2)
        best = (1e-6, None)
        for f in range(x.shape[1]) if level else ():
            for e in edges[f]:
                low = x[ix, f] <= e
                a, b = ix[low], ix[~low]
                if h[a].sum() < 1 or h[b].sum() < 1:
                    continue
                gain = sum(g[k].sum() ** 2 / (h[k].sum() + l2) for k in (a, b)) - g[ix].sum() ** 2 / (h[ix].sum() + l2)
                if gain > best[0] + 1e-9:
                    best = gain, (a, b)
        if best[1] is None:
            out = {int(i): leaf for i in ix}
            return out
        return {**tree(best[1][0], g, h, level - 1), **tree(best[1][1], g, h, level - 1)}

    for _ in range(rounds):
        p = boosted.softmax(margin)
        step = np.zeros_like(margin)
        for c in range(classes):
            g, h = p[:, c] - (y == c), 2 * p[:, c] * (1 - p[:, c])
            for i, v in tree(np.arange(len(x)), g, h, depth).items():
                step[i, c] = v
        margin += step
    return margin


@pytest.mark.parametrize("task_rows", [10_000, 100, 0])
def test_cuts_are_those_of_exhaustive_search(spark, task_rows):
    df, x, y = rows(spark, 300)
    edges = boosted._edges(df, 5, 16)
    model = fit(df, rounds=2, n_bins=16, task_rows=task_rows)
    assert np.allclose(model.margins(x), by_hand(x, y, 3, 2, 3, edges), atol=1e-5)


def test_same_trees_however_the_work_is_spread(spark):
    df, x, _ = rows(spark)
    more = dict(rounds=5, depth=4, subsample=0.8, columns=0.8)
    one = fit(df.coalesce(1), **more)
    for other in (fit(df.repartition(7), task_rows=60, **more), fit(df.repartition(3), task_rows=0, renew=2, **more)):
        assert np.allclose(one.margins(x), other.margins(x), atol=1e-6)
        key = lambda m: sorted(zip(m.table["tree"].tolist(), m.table["feature"].tolist(), m.table["threshold"].tolist()))
        assert key(one) == key(other)


def test_it_learns_and_copies_count_by_weight(spark):
    df, x, y = rows(spark, 1500)
    model = fit(df, rounds=30, depth=5, subsample=0.8)
    assert (model.margins(x).argmax(axis=1) == y).mean() > 0.97
    held, hx, hy = rows(spark, 600, seed=5)
    assert (model.margins(hx).argmax(axis=1) == hy).mean() > 0.93
    twice = fit(df.unionByName(df), rounds=2)
    heavy = fit(df.withColumn("weight", F.lit(2.0)), rounds=2)
    assert np.allclose(twice.margins(x), heavy.margins(x))
    got = md.predict(held, model).collect()
    assert all(sum(r.probability) == pytest.approx(1) for r in got)


def test_nodes_are_a_table_that_sql_scores_by(spark, new_dir):
    df, x, _ = rows(spark, 200)
    model = fit(df, rounds=4)
    model.save(spark, f"{new_dir}/nodes")
    again = boosted.BoostedTrees.load(spark, f"{new_dir}/nodes", 3)
    assert np.array_equal(again.margins(x), model.margins(x))
    db = duckdb.connect()
    db.register("x", spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>").toPandas())
    got = db.sql(f"""with recursive nodes as (select * from read_parquet('{new_dir}/nodes/*.parquet')),
        walk as (select i, v, n.* from x, nodes n where node = 0
                 union all select w.i, w.v, n.* from walk w join nodes n on n.tree = w.tree and w.feature >= 0
                   and n.node = case when w.v[w.feature + 1] > w.threshold then w.right_node else w.left_node end)
        select i, class_id, sum(value) as margin from walk where feature < 0 group by all order by i, class_id""").fetchall()
    assert np.allclose(np.array([m for _, _, m in got]).reshape(-1, 3), model.margins(x))


def test_missing_values_empty_input_and_one_class(spark):
    df, x, _ = rows(spark, 200)
    gone = df.withColumn("vector", F.transform("vector", lambda v, i: F.when((i == 1) & (v > 1), F.lit(None)).otherwise(v)))
    assert np.isfinite(fit(gone).margins(x)).all()
    nan = df.withColumn("vector", F.transform("vector", lambda v, i: F.when((i == 1) & (v > 1), F.lit(float("nan"))).otherwise(v)))
    assert np.array_equal(fit(gone).margins(x), fit(nan).margins(x))
    with pytest.raises(ValueError):
        fit(df.limit(0))
    with pytest.raises(ValueError):
        fit(df, n_bins=300)
    alone = fit(df.withColumn("y", F.lit(2)))
    assert (alone.margins(x).argmax(axis=1) == 2).all()

"""Learners trained by sums over the rows: a linear SVM for all folds and classes at once, a perceptron that stops early.

Every step is one pass over rows that are written once: tasks add up in numpy,
sums are added per problem in Spark, and what reaches the driver is as large as
the model, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.operators.session import cut

#: Rows that a part of the perceptron's training holds at most.
PART_ROWS = 500_000


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _sums(rows: DataFrame, partial) -> dict[int, np.ndarray]:
    """``partial(x, y, fold) -> {problem: vector}`` of every batch, added up by problem."""
    def run(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if len(batch):
                for k, v in partial(_matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()).items():
                    total[k] = total[k] + v if k in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["problem", "v"])

    def add(table):
        import pyarrow as pa

        return pa.table({"problem": table.column("problem").slice(0, 1), "v": pa.array([_matrix(table.column("v").combine_chunks()).sum(axis=0)], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(run, "problem int, v array<double>")
    return {r["problem"]: np.array(r["v"]) for r in parts.groupBy("problem").applyInArrow(add, "problem int, v array<double>").collect()}


def _newton(rows: DataFrame, start: np.ndarray, terms, iterations: int, penalty: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """Minimise one convex function per problem (a row of *start*) by Newton steps, all in the same passes.

    ``terms(at) -> partial``; a problem's vector holds loss, gradient and Hessian at its row of *at*.
    A step that makes a problem's value larger is halved; problems that stand still drop out.
    """
    n, d = start.shape
    at, step, best = start.copy(), np.zeros_like(start), np.full(n, np.inf)
    open_ = np.ones(n, dtype=bool)
    for _ in range(iterations):
        found = _sums(rows, terms(at + step, np.flatnonzero(open_)))
        for k in np.flatnonzero(open_).tolist():
            v = found.get(k)
            if v is None:
                open_[k] = False
                continue
            new = at[k] + step[k]
            value = v[0] + 0.5 * float(penalty @ (new * new))
            if value > best[k] + 1e-12 * abs(best[k]):
                step[k] /= 2
                open_[k] = np.abs(step[k]).max() > 1e-12
                continue
            gradient = v[1:d + 1] + penalty * new
            hessian = v[d + 1:].reshape(d, d) + np.diag(penalty + 1e-10)
            open_[k] = best[k] - value > tolerance * max(1.0, abs(value)) or not np.isfinite(best[k])
            at[k], best[k] = new, value
            step[k] = -np.linalg.solve(hessian, gradient)
        if not open_.any():
            break
    return at


def fit_svm_folds(train: DataFrame, n_classes: int, folds: int, iterations: int, reg: float, seed: int) -> list[list[tuple[list[float], float, float, float]]]:
    """Per fold and class: coefficients, intercept, and slope and shift of the sigmoid over the fold left out.

    The linear part minimises the squared hinge loss with balanced weights of class
    and rest; the sigmoid is fitted to smoothed targets.  All folds times classes
    share each pass.
    """
    rows = cut(train.select("vector", F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64(F.lit(seed), *train.columns), F.lit(folds)).cast("int").alias("fold")))

    def counted(x, y, fold):
        return {int(f): np.concatenate([[(fold == f).sum()], np.bincount(y[fold == f], minlength=n_classes), x[fold == f].sum(axis=0), (x[fold == f] ** 2).sum(axis=0)]) for f in np.unique(fold)}

    counts = _sums(rows, counted)
    if not counts:
        raise ValueError("no rows to fit")
    all_ = sum(counts.values())
    total, d = all_[0], (len(all_) - 1 - n_classes) // 2
    mean = all_[1 + n_classes:1 + n_classes + d] / total
    scale = np.sqrt(np.maximum(all_[1 + n_classes + d:] / total - mean**2, 0))
    scale = np.where(scale > 1e-12 * np.maximum(1, np.abs(mean)), scale, 1.0)
    own = np.array([counts.get(f, np.zeros_like(all_))[1:1 + n_classes] for f in range(folds)])  # fold x class
    fit_sizes = own.sum() - own.sum(axis=1)
    positives = own.sum(axis=0) - own  # rows of the class in the folds fitted on

    def margins(at):
        def terms(weights, live):
            def partial(x, y, fold):
                z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
                out = {}
                for k in live.tolist():
                    f, c = divmod(k, n_classes)
                    m, t = z[fold != f], np.where(y[fold != f] == c, 1.0, -1.0)
                    share = np.where(t > 0, 0.5 / max(positives[f, c], 1), 0.5 / max(fit_sizes[f] - positives[f, c], 1))
                    gap = 1 - t * (m @ weights[k])
                    near = gap > 0
                    m, t, share, gap = m[near], t[near], share[near], gap[near]
                    out[k] = np.concatenate([[(share * gap**2).sum()], -2 * (share * gap * t) @ m, (2 * (m * share[:, None]).T @ m).ravel()])
                return out
            return partial
        return terms(*at)

    penalty = np.append(np.full(d, reg), 0.0)
    weights = _newton(rows, np.zeros((folds * n_classes, d + 1)), lambda w, live: margins((w, live)), iterations, penalty)

    def sigmoid(curve, live):
        def partial(x, y, fold):
            z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
            out = {}
            for k in live.tolist():
                f, c = divmod(k, n_classes)
                held = fold == f
                pos, neg = own[f, c], own[f].sum() - own[f, c]
                m = np.column_stack([z[held] @ weights[k], np.ones(held.sum())])
                t = np.where(y[held] == c, (pos + 1) / (pos + 2), 1 / (neg + 2))
                s = m @ curve[k]
                p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
                out[k] = np.concatenate([[(np.logaddexp(0, s) - t * s).sum()], (p - t) @ m, ((m * (p * (1 - p) + 1e-12)[:, None]).T @ m).ravel()])
            return out
        return partial

    curves = _newton(rows, np.tile([1.0, 0.0], (folds * n_classes, 1)), sigmoid, 50, np.zeros(2))
    out = []
    for f in range(folds):
        out.append([])
        for c in range(n_classes):
            k = f * n_classes + c
            w = weights[k, :-1] / scale
            out[-1].append((w.tolist(), float(weights[k, -1] - w @ mean), float(curves[k, 0]), float(curves[k, 1])))
    return out


# --- perceptron ---------------------------------------------------------------------------

@dataclass
class Perceptron:
    """Layers of a perceptron (weights with a last row of biases), rectified but for the last, and how its training ended."""

    layers: list[np.ndarray]
    n_classes: int
    epochs: int = 0
    validation: tuple[float, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.sql.functions import pandas_udf

        layers = self.layers

        @pandas_udf("array<double>")
        def probability(vectors):
            import pandas as pd

            if not len(vectors):
                return pd.Series([], dtype=object)
            return pd.Series(list(forward(layers, np.stack(vectors.to_numpy()).astype(float))[-1]))

        return df.withColumn("probability", probability(F.col("vector").cast("array<double>")))


def forward(layers: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Outputs of every layer; the last are class probabilities."""
    out = [x]
    for i, w in enumerate(layers):
        z = out[-1] @ w[:-1] + w[-1]
        if i < len(layers) - 1:
            out.append(np.maximum(z, 0))
        else:
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(e / e.sum(axis=1, keepdims=True))
    return out


def gradients(layers: list[np.ndarray], x: np.ndarray, y: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Gradients of the mean cross entropy with a penalty on the weights."""
    out = forward(layers, x)
    delta = out[-1].copy()
    delta[np.arange(len(y)), y] -= 1
    delta /= len(y)
    found = []
    for w, below in zip(layers[::-1], out[-2::-1]):
        g = np.vstack([below.T @ delta, delta.sum(axis=0)])
        g[:-1] += penalty * w[:-1]
        found.append(g)
        delta = (delta @ w[:-1].T) * (below > 0)
    return found[::-1]


def fit_perceptron(
    train: DataFrame, n_classes: int, hidden: Sequence[int], iterations: int, patience: int, validation: float = 0.1,
    batch: int = 32, rate: float = 1e-3, penalty: float = 1e-4, shards: int = 8, seed: int = fv.SEED,
) -> Perceptron:
    """Train on *train* (vector, y) side by side in up to *shards* parts (more if one would hold over PART_ROWS rows), each of many batches;
    their weights are averaged after every epoch.

    A share of the rows, chosen by hash, is left out to watch the accuracy: when it
    has not risen for *patience* epochs the training stops with the best weights.
    """
    part = F.pmod(F.xxhash64(F.lit(seed), *train.columns), F.lit(10_000))
    rows = cut(train.select("vector", F.col("y").cast("int").alias("y"), (part < int(validation * 10_000)).cast("int").alias("fold")))
    moments = _sums(rows, lambda x, y, fold: {0: np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)])}).get(0)
    if moments is None:
        raise ValueError("no rows to fit")
    width = len(moments) // 2
    mean = moments[1:1 + width] / moments[0]
    scale = np.sqrt(np.maximum(moments[1 + width:] / moments[0] - mean**2, 0))
    scale = np.where(scale > 1e-12 * np.maximum(1, np.abs(mean)), scale, 1.0)
    parts = max(1, min(shards, int(moments[0]) // (16 * batch)), -(-int(moments[0]) // PART_ROWS))
    rows = cut(rows.repartition(parts, F.xxhash64("vector", F.lit(seed), F.rand(seed))))
    rng = np.random.default_rng(seed)
    sizes = [width, *hidden, n_classes]
    layers = [np.vstack([rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), np.zeros((1, b))]) for a, b in zip(sizes, sizes[1:])]
    shapes, ends = [w.shape for w in layers], np.cumsum([w.size for w in layers])
    pack = lambda ws: np.concatenate([w.ravel() for w in ws])
    unpack = lambda v: [p.reshape(s) for p, s in zip(np.split(v, ends[:-1]), shapes)]
    flat, m, v, steps = pack(layers), np.zeros(ends[-1]), np.zeros(ends[-1]), 0
    best, best_flat, waited, seen = -np.inf, flat, 0, []
    for epoch in range(iterations + 1):
        last = epoch == iterations

        def run(batches, flat=flat, m=m, v=v, steps=steps, epoch=epoch, last=last):
            import pyarrow as pa

            got = [((_matrix(b.column(0)) - mean) / scale, b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if len(b)]
            if not got:
                return
            x, y, held = (np.concatenate(c) for c in zip(*got))
            right = (forward(unpack(flat), x[held == 1])[-1].argmax(axis=1) == y[held == 1]).sum() if (held == 1).any() else 0
            x, y = x[held == 0], y[held == 0]
            w, m, v, t = flat.copy(), m.copy(), v.copy(), steps
            order = np.random.default_rng([seed, epoch]).permutation(len(y))
            for lo in range(0, 0 if last else len(y), batch):
                g = pack(gradients(unpack(w), x[order[lo:lo + batch]], y[order[lo:lo + batch]], penalty))
                t += 1
                m = 0.9 * m + 0.1 * g
                v = 0.999 * v + 0.001 * g * g
                w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            n = len(y)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int32()), pa.array([np.concatenate([[n, right, (held == 1).sum(), n * (t - steps)], n * w, n * m, n * v])], pa.list_(pa.float64()))], names=["problem", "v"])

        def add(table):
            import pyarrow as pa

            return pa.table({"problem": table.column("problem").slice(0, 1), "v": pa.array([_matrix(table.column("v").combine_chunks()).sum(axis=0)], pa.list_(pa.float64()))})

        total = np.array(rows.mapInArrow(run, "problem int, v array<double>").groupBy("problem").applyInArrow(add, "problem int, v array<double>").collect()[0]["v"])
        n, right, watched, taken = total[:4]
        if watched:
            score = right / watched
            seen.append(float(score))
            if score > best + 1e-4:
                best, best_flat, waited = score, flat, 0
            else:
                waited += 1
        else:
            best_flat = flat
        if waited >= patience or last:
            break
        flat, m, v = np.split(total[4:] / max(n, 1), 3)
        steps += round(taken / max(n, 1))
    layers = unpack(best_flat)
    inside = layers[0][:-1] / scale[:, None]  # the scaling of the inputs goes into the first layer
    layers[0] = np.vstack([inside, layers[0][-1] - mean @ inside])
    return Perceptron(layers, n_classes, epoch, tuple(seen))

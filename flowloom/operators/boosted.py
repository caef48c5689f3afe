"""Boosted trees for all classes at once: softmax gradients, features cut into bins once, one pass a level for every class.

Rows that agree in bins and class are one row with their summed weight, so copies
cost nothing.  Gradients are whole multiples of a power of two small enough that
their sums are exact: the trees don't depend on how rows are spread over tasks.
What reaches the driver is the chosen cuts, as large as the model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.operators.session import cut

NODES = "tree int, class_id int, node int, feature int, threshold double, left_node int, right_node int, value double"
_SPLITS = "root long, feature int, bin int, gain double, rows long, left_rows long, g long, h long, left_g long, left_h long"
#: Rows that need no spreading.
SMALL = 20_000
_SUBTREES = "root long, feature array<int>, bin array<int>, left_node array<int>, right_node array<int>, value array<double>"


@dataclass
class Tree:
    """A binary tree by node number; ``feature`` -1 is a leaf, a row goes right when its bin is above ``bin``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        lower, upper = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, at, lower, upper
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column += [empty, empty]
        return lower, upper

    def graft(self, node: int, sub: "Tree") -> None:
        """Put the root of *sub* in the place of the leaf *node*."""
        shift = len(self.feature) - 1
        place = lambda i: node if i == 0 else i + shift
        for i in range(len(sub.feature)):
            if i:
                self.feature.append(-1), self.bin.append(0), self.left.append(0), self.right.append(0), self.value.append(0.0)
            at = place(i)
            self.feature[at], self.bin[at], self.value[at] = sub.feature[i], sub.bin[i], sub.value[i]
            self.left[at], self.right[at] = place(sub.left[i]), place(sub.right[i])

    def packed(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature, np.int32), np.array(self.bin, np.int32), np.array(self.left, np.int32),
                np.array(self.right, np.int32), np.array(self.value))


def descend(feature: np.ndarray, limit: np.ndarray, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Node where every row of *x* ends; it goes right where its value is above the node's limit (NaN goes left)."""
    at = np.zeros(len(x), np.int32)
    live = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, np.int64)
    while len(live):
        node = at[live]
        at[live] = np.where(x[live, feature[node]] > limit[node], right[node], left[node])
        live = live[feature[at[live]] >= 0]
    return at


def best_splits(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node the feature, bin and gain of its best cut; *g* and *h* are sums by (node, feature, bin). Ties: first feature, first bin."""
    gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
    total_g, total_h = gl[:, :1, -1:], hl[:, :1, -1:]
    gr, hr = total_g - gl, total_h - hl
    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - total_g**2 / (total_h + l2)
    gain = np.where((hl >= least) & (hr >= least), gain, -np.inf).reshape(len(g), -1)
    best = gain.argmax(axis=1)
    return best // g.shape[2], best % g.shape[2], gain[np.arange(len(g)), best]


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, n_bins: int, unit: float, rate: float, l2: float, least: float) -> Tree:
    """A tree of at most *depth* levels on rows that fit in one task, all nodes of a level in the same counts."""
    tree, m = Tree(), bins.shape[1]
    at, nodes = np.zeros(len(bins), np.int64), [0]
    columns = np.arange(m) * n_bins
    for level in range(depth + 1):
        # rows of leaves have left; `at` counts the open nodes of this level
        k = len(nodes)
        sums = [np.bincount(at, v, k) for v in (g, h)]
        for i, node in enumerate(nodes):
            tree.value[node] = -rate * sums[0][i] * unit / (sums[1][i] * unit + l2)
        if level == depth:
            break
        cell = ((at * (m * n_bins))[:, None] + columns + bins).ravel()
        shape = (k, m, n_bins)
        gs, hs = (np.bincount(cell, np.repeat(v, m), k * m * n_bins).reshape(shape) * unit for v in (g, h))
        feature, edge, gain = best_splits(gs, hs, l2, least)
        ok = gain > 1e-6
        following, child = [], np.full((k, 2), -1)
        for i in np.flatnonzero(ok).tolist():
            child[i] = len(following), len(following) + 1
            following += tree.split(nodes[i], int(feature[i]), int(edge[i]))
        if not following:
            break
        stay = ok[at]
        bins, g, h, at = bins[stay], g[stay], h[stay], at[stay]
        at = child[at, (bins[np.arange(len(at)), feature[at]] > edge[at]).astype(int)]
        nodes = following
    return tree


@dataclass
class BoostedTrees:
    """Trees as one table of nodes (``table``, columns as in ``NODES``); class probabilities are the softmax of summed leaf values."""

    table: dict[str, np.ndarray]
    n_classes: int

    def _trees(self):
        t = self.table
        starts = np.flatnonzero(t["node"] == 0)
        for lo, hi in zip(starts, [*starts[1:], len(t["node"])]):
            yield int(t["class_id"][lo]), tuple(t[c][lo:hi] for c in ("feature", "threshold", "left_node", "right_node", "value"))

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.n_classes))
        for c, (feature, limit, left, right, value) in self._trees():
            out[:, c] += value[descend(feature, limit, left, right, x)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.sql.functions import pandas_udf

        @pandas_udf("array<double>")
        def probability(vectors):
            import pandas as pd

            if not len(vectors):
                return pd.Series([], dtype=object)
            return pd.Series(list(softmax(self.margins(np.stack(vectors.to_numpy()).astype(float)))))

        return df.withColumn("probability", probability(F.col("vector").cast("array<double>")))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The fitted trees as rows, one a node: what is saved, and what SQL can score by."""
        import pyarrow as pa

        return spark.createDataFrame(pa.table(self.table)).selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in NODES.split(", ")])

    def save(self, spark: SparkSession, path: str) -> None:
        self.nodes(spark).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, n_classes: int) -> "BoostedTrees":
        rows = spark.read.schema(NODES).parquet(path).orderBy("tree", "node").toPandas()
        return cls({c: rows[c].to_numpy() for c in rows.columns}, n_classes)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _edges(train: DataFrame, width: int, n_bins: int) -> list[np.ndarray]:
    """Per feature the distinct upper ends of its bins, from quantile sketches in one aggregate."""
    shares = [i / n_bins for i in range(1, n_bins)]
    value = lambda i: F.nullif(F.col("vector")[i].cast("double"), F.lit(float("nan")))
    row = train.agg(*[F.percentile_approx(value(i), shares, 10_000).alias(f"q{i}") for i in range(width)]).first()
    return [np.unique(np.array(q or [], dtype=float)) for q in row]


def fit(train: DataFrame, n_classes: int, rounds: int, depth: int, rate: float, subsample: float, columns: float, seed: int = fv.SEED,
        n_bins: int = 64, l2: float = 1.0, least: float = 1.0, task_rows: int | None = None, renew: int | None = None) -> BoostedTrees:
    """Fit *rounds* trees per class on ``vector``, ``y`` and ``weight``.

    A round takes a share *subsample* of the rows by hash and, per tree, a share
    *columns* of the features.  Nodes with more than *task_rows* rows are cut by
    sums over (node, feature, bin); the rest of the tree below a node with fewer
    is grown by one task, with the same sums and so the same cuts; it is 500,000 if
    their values are at most four million, else fewer.  Every *renew* rounds (20 up to
    SMALL rows, else 5: each pass walks the trees since then) the rows are written
    with their margins.  NULL and NaN values are below
    every cut.  No rows: ``ValueError``.
    """
    if not 2 <= n_bins <= 256:
        raise ValueError("between 2 and 256 bins")
    first = train.select(F.size("vector").alias("n"), "weight").agg(F.max("n"), F.sum("weight")).first()
    if first[0] is None:
        raise ValueError("no rows to fit")
    width, weight = int(first[0]), float(first[1])
    edges = _edges(train, width, n_bins)
    unit = 2.0 ** -min(30, 51 - math.ceil(math.log2(weight + 2)))

    def to_bins(batches):
        import pyarrow as pa

        for b in batches:
            x = np.array(b.column("vector").to_pylist(), dtype=float).reshape(len(b), width)
            bins = np.column_stack([np.where(np.isnan(x[:, i]), 0, np.searchsorted(e, x[:, i])) for i, e in enumerate(edges)]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([r.tobytes() for r in bins], pa.binary()), b.column("weight")], names=["y", "bins", "weight"])

    packed = train.select("vector", F.col("y").cast("int").alias("y"), F.col("weight").cast("double").alias("weight")).mapInArrow(to_bins, "y int, bins binary, weight double")
    rows = cut(packed.groupBy("y", "bins").agg(F.sum("weight").alias("weight")).select(
        "y", "bins", "weight", F.xxhash64(F.lit(seed), "y", "bins").alias("key"), F.array_repeat(F.lit(0.0), n_classes).alias("margin")))
    n_rows = rows.count()
    if n_rows > SMALL:  # few partitions are left of the aggregate
        rows = cut(rows.repartition(max(train.sparkSession.sparkContext.defaultParallelism, n_rows // 100_000), "key"))
    renew = renew or (20 if n_rows <= SMALL else 5)
    task_rows = max(SMALL, min(500_000, 4_000_000 // max(1, width))) if task_rows is None else task_rows
    rng = np.random.default_rng(seed)
    chosen_width = max(1, int(columns * width))
    done: list[list[Tree]] = []
    recent: list[list[Tree]] = []

    def opened(batch, late):
        """Bins and margins of a batch, the trees since the last writing included."""
        bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(len(batch), width)
        margin = batch.column("margin").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), n_classes).copy()
        for trees in late:
            for c, (feature, limit, left, right, value) in enumerate(trees):
                margin[:, c] += value[descend(feature, limit, left, right, bins)]
        return bins, margin

    def gradients(batch, late, number):
        """Bins of the round's share of a batch, gradients and curvatures in whole units."""
        with np.errstate(over="ignore"):
            mixed = (batch.column("key").to_numpy().astype(np.uint64) ^ np.uint64((number * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        keep = (mixed >> np.uint64(11)) < np.uint64(int(subsample * 2**53))
        bins, margin = opened(batch, late)
        y, w = batch.column("y").to_numpy()[keep], batch.column("weight").to_numpy()[keep][:, None]
        p = softmax(margin[keep]) if keep.any() else margin[keep]
        g = (p - (y[:, None] == np.arange(n_classes))) * w
        h = np.maximum(2 * p * (1 - p), 1e-16) * w
        return bins[keep], np.rint(g / unit), np.rint(h / unit)

    for number in range(rounds):
        late = [[t.packed() for t in trees] for trees in recent]
        features = [np.sort(rng.choice(width, chosen_width, replace=False)) for _ in range(n_classes)]
        trees = [Tree() for _ in range(n_classes)]
        open_, small = [(c, 0, n_rows) for c in range(n_classes)], {}
        for level in range(depth):
            small.update({(c, node): depth - level for c, node, n in open_ if n <= task_rows})
            open_ = [o for o in open_ if o[2] > task_rows]
            if not open_:
                break
            found = {r["root"]: r for r in _level(rows, trees, open_, features, gradients, late, number, n_bins, unit, l2, least).collect()}
            following = []
            for i, (c, node, _) in enumerate(open_):
                r = found.get(i)
                if r is None:
                    continue
                leaf = lambda g, h: -rate * g * unit / (h * unit + l2)
                trees[c].value[node] = leaf(r["g"], r["h"])
                if r["gain"] > 1e-6:
                    lower, upper = trees[c].split(node, int(features[c][r["feature"]]), r["bin"])
                    trees[c].value[lower], trees[c].value[upper] = leaf(r["left_g"], r["left_h"]), leaf(r["g"] - r["left_g"], r["h"] - r["left_h"])
                    following += [(c, lower, r["left_rows"]), (c, upper, r["rows"] - r["left_rows"])]
            open_ = following
        roots = list(small)
        if roots:
            for r in _subtrees(rows, trees, roots, small, features, gradients, late, number, n_bins, unit, rate, l2, least).collect():
                c, node = roots[r["root"]]
                names = [int(features[c][f]) if f >= 0 else -1 for f in r["feature"]]
                trees[c].graft(node, Tree(names, r["bin"], r["left_node"], r["right_node"], r["value"]))
        done.append(trees)
        recent.append(trees)
        if len(recent) == renew and number + 1 < rounds:
            late = [[t.packed() for t in trees] for trees in recent]

            def renewed(batches, late=late):
                import pyarrow as pa

                for b in batches:
                    margin = opened(b, late)[1]
                    yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(list(margin), pa.list_(pa.float64()))], names=b.schema.names)

            rows, recent = cut(rows.mapInArrow(renewed, rows.schema)), []
    table: dict[str, list] = {c.split()[0]: [] for c in NODES.split(", ")}
    for number, trees in enumerate(done):
        for c, t in enumerate(trees):
            n = len(t.feature)
            limit = [float(edges[f][b]) if f >= 0 else 0.0 for f, b in zip(t.feature, t.bin)]
            for name, values in zip(table, ([number * n_classes + c] * n, [c] * n, range(n), t.feature, limit, t.left, t.right, t.value)):
                table[name] += values
    types = {"threshold": np.float64, "value": np.float64}
    return BoostedTrees({k: np.array(v, types.get(k, np.int32)) for k, v in table.items()}, n_classes)


def _level(rows, trees, open_, features, gradients, late, number, n_bins, unit, l2, least) -> DataFrame:
    """The best cut of every open node, from sums by (node, feature, bin) that are added up in Spark."""
    shapes = [t.packed()[:4] for t in trees]
    m, k = len(features[0]), len(open_)
    place = [np.full(len(s[0]), -1) for s in shapes]
    for i, (c, node, _) in enumerate(open_):
        place[c][node] = i

    def count(batches):
        import pyarrow as pa

        sums = np.zeros((3, k * m * n_bins))
        for b in batches:
            bins, g, h = gradients(b, late, number)
            for c, shape in enumerate(shapes):
                at = place[c][descend(*shape, bins)]
                here = at >= 0
                if not here.any():
                    continue
                cell = ((at[here] * (m * n_bins))[:, None] + np.arange(m) * n_bins + bins[here][:, features[c]]).ravel()
                for s, v in zip(sums, (g[here, c], h[here, c], np.ones(here.sum()))):
                    s += np.bincount(cell, np.repeat(v, m), len(s))
        full = np.flatnonzero(sums[2])
        for lo in range(0, len(full), 100_000):
            cells = full[lo:lo + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells // (m * n_bins)), pa.array(cells % (m * n_bins)), *[pa.array(s[cells].astype(np.int64)) for s in sums]], names=["root", "cell", "g", "h", "n"])

    def choose(table):
        import pyarrow as pa

        cells = table.column("cell").to_numpy()
        g, h, n = (np.zeros(m * n_bins) for _ in range(3))
        for v, name in ((g, "g"), (h, "h"), (n, "n")):
            v[cells] = table.column(name).to_numpy()
        shape = (1, m, n_bins)
        feature, edge, gain = (v[0] for v in best_splits(g.reshape(shape) * unit, h.reshape(shape) * unit, l2, least))
        own = slice(feature * n_bins, (feature + 1) * n_bins)
        below = slice(feature * n_bins, feature * n_bins + edge + 1)
        whole = [int(v[own].sum()) for v in (n, g, h)]
        part = [int(v[below].sum()) for v in (n, g, h)]
        out = {"root": table.column("root")[0].as_py(), "feature": int(feature), "bin": int(edge), "gain": float(gain), "rows": whole[0], "left_rows": part[0],
               "g": whole[1], "h": whole[2], "left_g": part[1], "left_h": part[2]}
        kinds = {"feature": pa.int32(), "bin": pa.int32(), "gain": pa.float64()}
        return pa.table({c: pa.array([v], kinds.get(c, pa.int64())) for c, v in out.items()})

    counted = rows.mapInArrow(count, "root long, cell long, g long, h long, n long").repartition("root")
    return counted.groupBy("root", "cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).groupBy("root").applyInArrow(choose, _SPLITS)


def _subtrees(rows, trees, roots, levels, features, gradients, late, number, n_bins, unit, rate, l2, least) -> DataFrame:
    """What hangs below every node in *roots*: its rows, few enough for a task, meet and grow it."""
    shapes = [t.packed()[:4] for t in trees]
    place = [np.full(len(s[0]), -1) for s in shapes]
    for i, (c, node) in enumerate(roots):
        place[c][node] = i
    left = [levels[r] for r in roots]
    owners = [c for c, _ in roots]

    def deal(batches):
        import pyarrow as pa

        for b in batches:
            bins, g, h = gradients(b, late, number)
            for c, shape in enumerate(shapes):
                at = place[c][descend(*shape, bins)]
                here = np.flatnonzero(at >= 0)
                here = here[np.argsort(at[here], kind="stable")]
                ids, starts = np.unique(at[here], return_index=True)
                own = np.split(here, starts[1:])
                if len(here):  # a row for each node
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids), *[pa.array([v[o].tobytes() for o in own], pa.binary()) for v in (bins[:, features[c]], g[:, c], h[:, c])]], names=["root", "bins", "g", "h"])

    def finish(table):
        import pyarrow as pa

        root = table.column("root")[0].as_py()
        bins, g, h = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("bins", np.uint8), ("g", np.float64), ("h", np.float64)))
        tree = grow(bins.reshape(len(g), len(features[owners[root]])), g, h, left[root], n_bins, unit, rate, l2, least)
        ints = pa.list_(pa.int32())
        return pa.table({"root": pa.array([root], pa.int64()), "feature": pa.array([tree.feature], ints), "bin": pa.array([tree.bin], ints),
                         "left_node": pa.array([tree.left], ints), "right_node": pa.array([tree.right], ints), "value": pa.array([tree.value], pa.list_(pa.float64()))})

    dealt = rows.mapInArrow(deal, "root long, bins binary, g binary, h binary").repartition(2 * len(roots), "root")
    return dealt.groupBy("root").applyInArrow(finish, _SUBTREES)

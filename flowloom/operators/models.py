"""Training, scoring and unseen-class evaluation of flow classifiers.

Training rows have an array column ``vector``, an integer class ``y`` and,
where a learner takes weights, ``weight``.  Every ``fit_*`` function returns a
model whose ``transform`` adds the MLlib vector column ``probability``.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.operators import boosted, forest, metrics
from flowloom.operators.boosted import BoostedTrees
from flowloom.operators.forest import Forest
from flowloom.operators.prep import Params, row_hash, transform
from flowloom.operators.rules import rejected_result
from flowloom.operators.running import taken_by_hash
from flowloom.operators.trained import Perceptron, fit_perceptron, fit_svm_folds


def check_training_inputs(train: DataFrame, test: DataFrame, n_classes: int) -> None:
    """Both parts: equal vector lengths, finite values, and every class present."""
    widths = set()
    for name, df in (("training", train), ("holdout", test)):
        bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        row = df.agg(
            F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi"), F.count_if(bad).alias("bad"),
            F.count("*").alias("n"), F.array_sort(F.collect_set("y")).alias("classes")).first()
        if row["n"] == 0 or row["lo"] != row["hi"]:
            raise ValueError(f"{name} vectors are empty or of different lengths")
        if row["bad"]:
            raise ValueError(f"{name} vectors hold {row['bad']} rows with non-finite values")
        if row["classes"] != list(range(n_classes)):
            raise ValueError(f"{name} labels cover classes {row['classes']}, expected 0..{n_classes - 1}")
        widths.add(row["hi"])
    if len(widths) > 1:
        raise ValueError("training and holdout vectors differ in length")


# --- subset and weights ----------------------------------------------------------------

def allocate(counts: dict, size: int, rare: int = fv.RARE_CLASS_ROWS) -> dict:
    """Rows to take per class: proportional, at least one, rare classes whole, exactly *size* in total."""
    total, classes = sum(counts.values()), sorted(counts)
    if not 0 < size <= total:
        raise ValueError("subset size must be between 1 and the number of rows")
    if size < len(classes):
        raise ValueError("subset too small to hold every class")
    share = {c: counts[c] if counts[c] <= rare else max(1, counts[c] * size // total) for c in classes}
    gap = size - sum(share.values())
    # every row more or less is a unit with a rank; the best units close the gap at once
    units = []
    for place, c in enumerate(classes):
        if gap > 0:  # the next rows of a class rank by its size and by how many rows of it are left out
            units += [(counts[c] * (counts[c] - k), -place, c) for k in range(share[c], min(counts[c], share[c] + gap))]
        elif counts[c] > rare:  # the last rows of the largest shares go first, never a class's only row
            units += [(height, -place, c) for height in range(max(2, share[c] + gap + 1), share[c] + 1)]
    picked = Counter(c for _, _, c in heapq.nlargest(abs(gap), units))
    if picked.total() < abs(gap):
        raise ValueError("rare classes alone exceed the subset size")
    return {c: share[c] + (picked[c] if gap > 0 else -picked[c]) for c in classes}


def class_aware_subset(df: DataFrame, size: int, id_cols: Sequence[str], label: str = fv.TARGET, seed: int = fv.SEED) -> DataFrame:
    """*size* rows with every class represented, chosen by row hash."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # one row per class
    quota = df.sparkSession.createDataFrame(
        list(allocate(counts, size).items()), df.select(label).schema.add("quota", "long"))
    return taken_by_hash(df, label, row_hash(id_cols, seed), quota)


def with_balanced_weight(df: DataFrame, label: str = "y") -> DataFrame:
    """Add ``weight`` = rows / (classes x rows of the class)."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # one row per class
    n, k = sum(counts.values()), len(counts)
    weight = F.create_map(*[F.lit(x) for c, m in counts.items() for x in (c, n / (k * m))]) if counts else F.lit(None).cast("map<int,double>")
    return df.withColumn("weight", F.element_at(weight, F.col(label)))


def resample_by_weight(df: DataFrame, id_cols: Sequence[str] | None = None, seed: int = fv.SEED) -> DataFrame:
    """Repeat rows in proportion to ``weight`` (for learners without weights): rows of the least weight once, so that none
    is lost; the fraction is decided by a row hash."""
    cols = list(id_cols or df.columns)
    least = df.agg(F.min("weight")).first()[0]
    if least is None:
        return df
    share = F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1_000_000)) / 1e6
    weight = F.col("weight") / F.lit(least)
    times = F.floor(weight + 1e-9) + F.when(share < weight - F.floor(weight + 1e-9), 1).otherwise(0)
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).drop("_copy")


def _ready(df: DataFrame) -> DataFrame:
    return df.withColumns({"features": array_to_vector("vector"), "label": F.col("y").cast("double")})


@dataclass
class Fitted:
    """An MLlib model together with the number of classes of its probability vector."""

    model: object
    n_classes: int

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df.withColumn("features", array_to_vector("vector")))
        return out.select(*df.columns, vector_to_array("probability").alias("probability"))


def fit_random_forest(train: DataFrame, n_classes: int, trees: int = fv.FOREST_TREES, depth: int = fv.FOREST_DEPTH, seed: int = fv.SEED) -> Forest:
    """Random forest with balanced weights on any number of rows."""
    return forest.fit(with_balanced_weight(train), n_classes, trees, depth, seed)


def fit_small_forest(train: DataFrame, n_classes: int, trees: int = fv.FOREST_TREES, depth: int = fv.FOREST_DEPTH, seed: int = fv.SEED) -> Fitted:
    """MLlib's forest, whose trees the driver holds: for a few thousand rows."""
    learner = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight", subsamplingRate=1.0, maxMemoryInMB=1024)
    return Fitted(learner.fit(_ready(with_balanced_weight(train))), n_classes)


def fit_boosted_trees(train: DataFrame, n_classes: int, rounds: int = fv.BOOST_ROUNDS, depth: int = fv.BOOST_DEPTH, rate: float = fv.BOOST_RATE,
                      subsample: float = fv.BOOST_SUBSAMPLE, columns: float = fv.BOOST_COLUMNS, seed: int = fv.SEED) -> BoostedTrees:
    """Gradient-boosted trees, one ensemble with a softmax over all classes, balanced weights."""
    return boosted.fit(with_balanced_weight(train), n_classes, rounds, depth, rate, subsample, columns, seed)


def fit_mlp(train: DataFrame, n_classes: int, hidden: Sequence[int] = fv.MLP_LAYERS, iterations: int = fv.MLP_ITERATIONS,
            patience: int = fv.MLP_PATIENCE, seed: int = fv.SEED) -> Perceptron:
    """Multilayer perceptron on rows repeated by their balanced weights; a tenth of them tells when to stop."""
    return fit_perceptron(resample_by_weight(with_balanced_weight(train)).select("vector", "y"), n_classes, hidden, iterations, patience, seed=seed)


@dataclass
class CalibratedSvm:
    """Linear margins with a fitted sigmoid, per fold and class: scoring is plain arithmetic."""

    folds: list[list[tuple[list[float], float, float, float]]]
    n_classes: int

    def transform(self, df: DataFrame) -> DataFrame:
        def probability(coef, bias, slope, shift):
            terms = F.zip_with("vector", F.array(*[F.lit(float(c)) for c in coef]), lambda x, c: x.cast("double") * c)
            margin = F.aggregate(terms, F.lit(float(bias)), lambda a, t: a + t)
            return 1 / (1 + F.exp(-(margin * slope + shift)))

        out, names = df, []
        for f, classes in enumerate(self.folds):
            cols = {f"_m{f}_{i}": probability(*c) for i, c in enumerate(classes)}
            out = out.withColumns(cols)
            names.append(list(cols))
        per_fold = []
        for cols in names:
            total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
            per_fold.append([F.coalesce(F.try_divide(F.col(c), total), F.lit(1.0 / len(cols))) for c in cols])
        mean = [sum(ps[1:], ps[0]) / len(ps) for ps in zip(*per_fold)]
        return out.select(*df.columns, F.array(*mean).alias("probability"))


def fit_linear_svm(train: DataFrame, n_classes: int, folds: int = 3, iterations: int = 100, reg: float = 1e-4, seed: int = fv.SEED) -> CalibratedSvm:
    """Linear SVM per class, calibrated on the fold left out; folds by row hash; all of them fitted in the same passes."""
    return CalibratedSvm(fit_svm_folds(train.select("vector", "y"), n_classes, folds, iterations, reg, seed), n_classes)


# --- scoring ------------------------------------------------------------------------------

def predict(df: DataFrame, model) -> DataFrame:
    """Add ``yhat`` (first class with the highest probability) and ``confidence``."""
    out = model.transform(df)
    top = F.array_max("probability")
    return out.withColumns({"confidence": top, "yhat": (F.array_position("probability", top) - 1).cast("int")})


def score(flows: DataFrame, model, params: Params, classes: Sequence[str] = fv.CLASSES, model_version: str = "") -> DataFrame:
    """Raw flow features -> prediction rows; rows that cannot be transformed become REJECTED without reaching the model."""
    keep = [c for c in flows.columns if c != "vector"]
    prepared = transform(flows.select(*keep), params)
    good = predict(prepared.filter("success"), model)
    label = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("yhat") + 1)
    good = good.withColumns({
        "class_id": F.col("yhat"), "label": label,
        "class_probabilities": F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), F.col("probability"))})
    good = good.withColumn("is_attack", F.col("label") != "BENIGN").withColumn(
        "status", F.when(F.col("is_attack"), "ATTACK").otherwise("BENIGN"))
    bad = prepared.filter("not success").withColumns(rejected_result(F.col("error"), F.col("rejected_fields")))
    cols = [*keep, "status", "class_id", "label", "is_attack", "confidence", "class_probabilities", "feature_quality",
            "missing_fields", "imputed_fields", "rejected_fields", "error"]
    return good.select(*cols).unionByName(bad.select(*cols)).withColumns({
        "model_version": F.lit(model_version), "preprocessing_version": F.lit(params.version)})


def unseen_class_eval(
    train: DataFrame, test: DataFrame, fit: Callable[[DataFrame, int], object],
    known: Sequence[int] = fv.KNOWN_CLASSES, unseen: Sequence[int] = fv.UNSEEN_CLASSES,
) -> tuple[DataFrame, DataFrame]:
    """Train on *known* classes, judge benign rows and *unseen* classes: (one-row report, predictions)."""
    known = list(known)
    code = F.create_map(*[F.lit(x) for new, old in enumerate(known) for x in (old, new)])
    back = F.array(*[F.lit(c) for c in known])
    fit_rows = train.filter(F.col("y").isin(known)).withColumn("y", F.element_at(code, F.col("y")))
    model = fit(fit_rows, len(known))
    judged = predict(test.filter(F.col("y").isin(0, *unseen)), model)
    judged = judged.withColumn("yhat", F.element_at(back, F.col("yhat") + 1))
    return metrics.detection_report(judged), judged

"""Evaluation of class predictions (columns ``y``, ``yhat`` and ``confidence``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowloom import fixed_values as fv


def class_dimension(spark, classes: Sequence[str] = fv.CLASSES) -> DataFrame:
    return spark.createDataFrame(list(enumerate(classes)), "class_id int, label string")


def _pairs(pred: DataFrame) -> DataFrame:
    """Rows per (true, predicted) class: everything below works on these at most classes^2 rows."""
    return pred.groupBy("y", "yhat").agg(F.count("*").alias("n"))


def confusion_matrix(pred: DataFrame, classes: Sequence[str] = fv.CLASSES) -> DataFrame:
    """All (true, predicted) pairs with count and share of the true class (0 when it has no rows)."""
    ids = F.array(*[F.lit(i) for i in range(len(classes))])
    grid = pred.sparkSession.range(1).select(F.explode(ids).alias("y")).withColumn("yhat", F.explode(ids))
    full = grid.join(_pairs(pred), ["y", "yhat"], "left").fillna(0, ["n"])
    total = F.sum("n").over(W.partitionBy("y"))
    return full.withColumn("share", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)))


def _per_class(pred: DataFrame) -> DataFrame:
    """Per class that occurs as truth or prediction: tp, predicted, support, precision, recall, f1."""
    pairs = _pairs(pred)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("y").alias("class_id"), F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("predicted"), F.col("n").alias("support")),
        F.struct(F.col("yhat").alias("class_id"), F.lit(0).cast("long").alias("tp"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("support")))).alias("s")).select("s.*")
    c = sides.groupBy("class_id").agg(*[F.sum(x).alias(x) for x in ("tp", "predicted", "support")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    c = c.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    p, r = F.col("precision"), F.col("recall")
    return c.withColumn("f1", ratio(2 * p * r, p + r))


def classification_metrics(pred: DataFrame) -> DataFrame:
    """One row: accuracy, balanced accuracy, macro precision/recall/F1 and weighted F1."""
    weight = F.col("support") / F.sum("support").over(W.partitionBy(F.lit(1)))  # one row per class
    c = _per_class(pred).withColumn("w", weight)
    return c.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"), F.sum(F.col("f1") * F.col("w")).alias("weighted_f1"))


def classification_report(pred: DataFrame, classes: Sequence[str] = fv.CLASSES) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted averages over all classes."""
    dims = class_dimension(pred.sparkSession, classes)
    full = dims.join(_per_class(pred), "class_id", "left").fillna(0)
    rows = full.select("label", "precision", "recall", "f1", "support")
    macro = full.agg(*[F.avg(m).alias(m) for m in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    weighted = full.agg(*[
        F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(m)
        for m in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    named = lambda d, n: d.select(F.lit(n).alias("label"), "precision", "recall", "f1", "support")
    return rows.unionByName(named(macro, "macro avg")).unionByName(named(weighted, "weighted avg"))


def compare_models(predictions: Mapping[str, DataFrame]) -> DataFrame:
    """One metrics row per model, with the winner by macro F1 marked (name breaks ties)."""
    table = None
    for name, pred in predictions.items():
        row = classification_metrics(pred).withColumn("model", F.lit(name))
        table = row if table is None else table.unionByName(row)
    best = W.partitionBy(F.lit(1)).orderBy(F.desc(F.round("macro_f1", 12)), "model")  # one row per model
    return table.withColumn("is_winner", F.row_number().over(best) == 1)


def detection_report(pred: DataFrame) -> DataFrame:
    """One row: how unseen attacks (y != 0) and benign rows (y = 0) were judged."""
    attack, flagged = F.col("y") != 0, F.col("yhat") != 0
    share = lambda of, hit: F.coalesce(F.avg(F.when(of, hit.cast("double"))), F.lit(0.0))
    return pred.agg(
        F.count_if(attack).alias("test_attack_rows"), F.count_if(~attack).alias("test_benign_rows"),
        F.round(share(attack, flagged), 6).alias("detection_rate"),
        F.round(share(~attack, flagged), 6).alias("false_alarm_rate"),
        F.round(F.coalesce(F.avg(F.when(attack, F.col("confidence"))), F.lit(0.0)), 6).alias("mean_confidence_attack"),
        F.round(F.coalesce(F.avg(F.when(~attack, F.col("confidence"))), F.lit(0.0)), 6).alias("mean_confidence_benign"))


def unseen_distribution(pred: DataFrame, classes: Sequence[str] = fv.CLASSES) -> DataFrame:
    """How attack rows were classified: classes that occur, with counts."""
    counts = pred.filter("y <> 0").groupBy(F.col("yhat").alias("class_id")).agg(F.count("*").alias("rows"))
    return counts.join(class_dimension(pred.sparkSession, classes), "class_id").select("label", "rows")


def confidence_histogram(pred: DataFrame, bins: int = fv.CONFIDENCE_BINS) -> DataFrame:
    """Rows per confidence bin for benign and attack rows, bins spanning each group's own range."""
    kind = F.when(F.col("y") == 0, "benign").otherwise("attack")
    rows = pred.select(kind.alias("kind"), "confidence")
    span = rows.groupBy("kind").agg(F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))
    # numpy-style range: a single value is widened by half on both sides
    same = F.col("lo") == F.col("hi")
    span = span.select("kind", F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                       F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.floor((F.col("confidence") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    binned = rows.join(F.broadcast(span), "kind").select("kind", F.least(at, F.lit(bins - 1)).cast("long").alias("bin"))
    counts = binned.groupBy("kind", "bin").agg(F.count("*").alias("rows"))
    axis = span.select("kind", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return axis.join(counts, ["kind", "bin"], "left").fillna(0, ["rows"])


def prediction_counts(pred: DataFrame, classes: Sequence[str] = fv.CLASSES) -> DataFrame:
    """Rows per predicted class, classes without any included."""
    counts = pred.groupBy(F.col("yhat").alias("class_id")).agg(F.count("*").alias("rows"))
    return class_dimension(pred.sparkSession, classes).join(counts, "class_id", "left").fillna(0, ["rows"])

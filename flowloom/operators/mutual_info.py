"""Mutual information between numeric features and a class label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowloom import fixed_values as fv
from flowloom.operators.running import ordered_chunks, running_total
from flowloom.operators.session import cut


def mutual_information(df: DataFrame, cols: Sequence[str], label: str, method: str = "knn", bins: int = 32, k: int = fv.MI_NEIGHBOURS) -> DataFrame:
    """(feature, score) rows in nats."""
    if method == "binned":
        return _binned(df, cols, label, bins)
    if method == "knn":
        return _nearest(df, cols, label, k)
    raise ValueError(f"unknown method {method!r}")


def _long(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(feature, label, value, n): equal values of a class collapse to one weighted row before any shuffle."""
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols]
    long = df.select(F.col(label).alias("label"), F.explode(F.array(*entries)).alias("e")).select("label", "e.*")
    return long.groupBy("feature", "label", "value").agg(F.count("*").alias("n"))


def _binned(df: DataFrame, cols: Sequence[str], label: str, bins: int) -> DataFrame:
    """Equal-width bins over each feature's range; sum of p(x,y) ln(p(x,y) / p(x)p(y))."""
    row = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in cols]).first()

    def bin_of(c):
        lo, hi = row[c]["lo"], row[c]["hi"]
        if lo is None or hi <= lo:
            return F.lit(0).cast("long")
        return F.least(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("long")

    entries = [F.struct(F.lit(c).alias("feature"), bin_of(c).alias("bin")) for c in cols]
    joint = df.select(F.col(label).alias("label"), F.explode(F.array(*entries)).alias("e")).groupBy(
        "e.feature", "e.bin", "label").agg(F.count("*").cast("double").alias("n"))
    # at most features x bins x classes rows from here on
    total = lambda *keys: F.sum("n").over(W.partitionBy("feature", *keys))
    parts = joint.select("feature", "n", total().alias("all"), total("bin").alias("nx"), total("label").alias("ny"))
    term = F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))
    return parts.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("score"))


def digamma(x) -> Column:
    """Digamma of a positive number: recurrence up to x + 10, then the asymptotic series."""
    x = x.cast("double")
    y = x + 10
    inv = 1 / (y * y)
    series = F.log(y) - 0.5 / y - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv * (1 / 240))))
    return series - sum((1 / (x + i) for i in range(1, 10)), 1 / x)


def _nearest(df: DataFrame, cols: Sequence[str], label: str, k: int) -> DataFrame:
    """Nearest-neighbour estimator for a discrete label and a continuous feature (Ross 2014).

    For each row: the distance to its k-th nearest row of the same class, then
    the number m of rows of any class strictly closer (copies of the value when
    that distance is 0), itself included.  Score = psi(N) + <psi(k)> -
    <psi(N_class)> - <psi(m)>, not below 0; classes of one row are left out.
    For a value with more than k copies in its class, k becomes the number of
    those copies (Gao et al. 2017), so repeated values need no random noise.
    Both steps work on weighted distinct values in ordered chunks, so neither
    a feature nor a class has to fit one task.
    """
    points = _with_class_size(cut(_long(df, cols, label)), k)  # read by several jobs
    ends = _open_interval(_with_neighbours(points, k))

    marks = F.array(
        F.struct(F.col("lo").alias("at"), F.when(F.col("copies_only"), 0).otherwise(2).alias("rank"), F.lit(-1).alias("sign")),
        F.struct(F.col("hi").alias("at"), F.when(F.col("copies_only"), 2).otherwise(0).alias("rank"), F.lit(1).alias("sign")))
    ends = cut(ends.withColumn("kk", F.when(F.col("copies_only"), F.col("n")).otherwise(F.col("kk"))))  # bounds of the chunks are told from them first
    asked = ends.select("feature", "label", "value", "n", "nc", "kk", F.explode(marks).alias("q")).select(
        "feature", "label", "value", "n", "nc", "kk", "q.*", F.lit(0).cast("long").alias("w"))
    # rank 0 comes before the values at its position, rank 2 after them
    held = points.groupBy("feature", F.col("value").alias("at")).agg(F.sum("n").alias("w")).withColumn("rank", F.lit(1))
    line = running_total(asked.unionByName(held, allowMissingColumns=True), ["feature"], ["at", "rank"], {"below": F.col("w")})
    inner = line.filter("sign is not null").groupBy("feature", "label", "value", "n", "nc", "kk").agg(
        F.sum(F.col("sign") * F.col("below")).alias("m"))
    weigh = lambda c: F.sum(F.col("n") * digamma(F.col(c)))
    total = F.sum("n")
    score = digamma(total) + (weigh("kk") - weigh("nc") - weigh("m")) / total
    return inner.groupBy("feature").agg(F.greatest(score, F.lit(0.0)).alias("score"))


def _with_class_size(points: DataFrame, k: int) -> DataFrame:
    """Add rows per class (nc) and the neighbour number used (kk); one-row classes go."""
    sizes = points.groupBy("feature", "label").agg(F.sum("n").alias("nc")).filter("nc > 1")
    return points.join(F.broadcast(sizes), ["feature", "label"]).withColumn(  # features x classes rows
        "kk", F.least(F.lit(k), F.col("nc") - 1))


def _with_neighbours(points: DataFrame, k: int) -> DataFrame:
    """Add ``near``: the k next smaller and k next larger values of the class, with their row counts.

    Chunks are handed the k values before and after them.
    """
    chunks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = ordered_chunks(points, ["feature", "label", "value"], chunks)
    part = ["feature", "label", "_chunk"]
    inside = W.partitionBy(*part)
    pair = F.struct("value", "n")
    edge = base.withColumns({
        "up": F.row_number().over(inside.orderBy("value")), "down": F.row_number().over(inside.orderBy(F.desc("value")))
    }).filter((F.col("up") <= k) | (F.col("down") <= k))
    along = W.partitionBy("feature", "label").orderBy("value")  # 2k rows per chunk
    reach = lambda fn, first: F.when(F.col(first) == 1, F.array_compact(F.array(*[fn(pair, i).over(along) for i in range(1, k + 1)])))
    halo = edge.select(*part, reach(F.lag, "up").alias("before"), reach(F.lead, "down").alias("after")).select(
        *part, F.explode(F.concat(F.coalesce("before", F.array()), F.coalesce("after", F.array()))).alias("h")).select(
        *part, "h.value", "h.n", F.lit(True).alias("halo"))
    rows = base.withColumn("halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    order = inside.orderBy("value")
    near = F.array_compact(F.array(*[fn(pair, i).over(order) for fn in (F.lag, F.lead) for i in range(1, k + 1)]))
    return rows.withColumn("near", near).filter("not halo").drop("halo", "_chunk")


def _open_interval(points: DataFrame) -> DataFrame:
    """Ends of the interval whose inside counts as closer than the kk-th neighbour of the class."""
    x = F.col("value")
    by_distance = F.array_sort(F.transform("near", lambda p: F.struct(
        F.abs(p["value"] - x).alias("d"), p["value"].alias("value"), p["n"].alias("n"))))
    start = F.struct((F.col("n") - 1).alias("seen"), F.lit(0.0).alias("d"))
    walk = F.aggregate("by_distance", start, lambda acc, p: F.when(acc["seen"] >= F.col("kk"), acc).otherwise(
        F.struct((acc["seen"] + p["n"]).alias("seen"), p["d"].alias("d"))))
    at_radius = lambda side: F.array_max(F.transform(F.filter(
        "by_distance", lambda p: (p["d"] == F.col("r")) & (p["value"] < x if side < 0 else p["value"] > x)), lambda p: p["value"]))
    out = points.withColumn("by_distance", by_distance).withColumn("r", walk["d"])
    # where a value of the class lies exactly at the radius, the end is that value (no rounding)
    return out.withColumns({
        "copies_only": F.col("r") == 0,
        "lo": F.coalesce(at_radius(-1), x - F.col("r")), "hi": F.coalesce(at_radius(1), x + F.col("r")),
    }).drop("near", "by_distance", "r")

"""Leakage-safe preparation of labelled flows: split, fit on the train part, transform.

``fit_*`` functions read the train part with one aggregate each and return
plain Python values, a few per feature (like an ML estimator does);
``transform`` and the ``apply_*`` functions are single projections built from
those values.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowloom import fixed_values as fv
from flowloom.functions.scalar import finite_number
from flowloom.operators.running import smallest_by_hash
from flowloom.operators.session import cut


def _names(cols: Sequence[str]) -> list[str]:
    return [fv.DISPLAY_NAMES.get(c, c) for c in cols]


# --- split ------------------------------------------------------------------------

def class_day_coverage(df: DataFrame) -> DataFrame:
    """Days on which each class occurs, sorted."""
    days = df.select(fv.TARGET, "_capture_day").distinct()
    return days.groupBy(fv.TARGET).agg(F.array_sort(F.collect_list("_capture_day")).alias("days"))


def row_hash(id_cols: Sequence[str | Column], seed: int = fv.SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in id_cols]))


def stratified_split(
    df: DataFrame, id_cols: Sequence[str | Column], label: str = fv.TARGET, train_share: float = fv.TRAIN_SHARE, seed: int = fv.SEED,
    settled: bool = False,
) -> DataFrame:
    """Add ``part``: the share of every class with the smallest row hashes is ``train``, the rest ``test``.

    *id_cols* must identify a row.  A class with fewer than two rows stops the job.
    Rows are written once with their hash, so that neither they nor it are derived again.  With *settled*, ``part`` is
    a mere comparison with one value a class whenever they are read.
    """
    hashed = cut(df.withColumn("_hash", F.unhex(row_hash(id_cols, seed))))
    n = F.count("*")
    enough = F.when(n >= 2, F.floor(n * train_share + 0.5)).otherwise(
        F.raise_error(F.lit("every class needs at least two rows")).cast("long"))
    quota = hashed.groupBy(label).agg(enough.cast("long").alias("quota"))
    picked = smallest_by_hash(hashed, label, F.col("_hash"), quota, digits=2, settled=settled)
    return picked.withColumn("part", F.when(F.col("_picked"), "train").otherwise("test")).drop("_picked")


def split_audit(df: DataFrame) -> DataFrame:
    """Rows per part for every label and every source file."""
    by = lambda kind, c: df.groupBy("part", F.lit(kind).alias("kind"), F.col(c).alias("value")).agg(F.count("*").alias("rows"))
    return by("label", fv.TARGET).unionByName(by("file", "_source_file"))


def fit_label_index(train: DataFrame, label: str = fv.TARGET) -> list[str]:
    """Distinct training labels in sorted order; a label's position is its code."""
    return sorted(r[0] for r in train.select(label).distinct().collect())


def apply_label_index(df: DataFrame, labels: Sequence[str], label: str = fv.TARGET) -> DataFrame:
    """Add ``y``; a label not seen in training stops the job when it is read."""
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label))
    unknown = F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(F.col(label), F.lit("NULL")))).cast("int")
    return df.withColumn("y", F.when(position > 0, (position - 1).cast("int")).otherwise(unknown))


# --- exact quantiles ------------------------------------------------------------------

#: A sketch's rank error is hardly ever above one in so many.
ACCURACY = 2_500
#: Values left inside a bracket that are sorted rather than bracketed again.
FEW = 50_000
#: Expressions of one aggregate; more take another pass.
EXPRESSIONS = 600


def _one_row(df: DataFrame, exprs: dict) -> dict:
    """Values of the aggregates *exprs* (key -> column), at most EXPRESSIONS of them a pass."""
    keys = list(exprs)
    out = {}
    for lo in range(0, len(keys), EXPRESSIONS):
        part = keys[lo:lo + EXPRESSIONS]
        out.update(zip(part, df.agg(*[exprs[k].alias(f"e{i}") for i, k in enumerate(part)]).first()))
    return out


@dataclass
class _Bracket:
    """Values between *lo* and *hi*, both left out: sorted, they have the positions *first* to *last* - 1 of their column."""

    column: str
    lo: float | None
    hi: float | None
    first: int
    last: int

    @property
    def key(self):
        return self.column, self.lo, self.hi

    def inside(self) -> Column:
        value = F.col(self.column).cast("double")
        kept = value.isNotNull()
        kept = kept if self.lo is None else kept & (value > self.lo)
        return F.when(kept if self.hi is None else kept & (value < self.hi), value)


def _holding(df: DataFrame, brackets: Sequence[_Bracket]) -> DataFrame:
    """The rows with a value inside any of *brackets*; all others would add nothing to an aggregate over them."""
    return df.filter(functools.reduce(Column.__or__, [b.inside().isNotNull() for b in {b.key: b for b in brackets}.values()]))


def _proposed(value: Column, shares: set[float], accuracy: int) -> Column:
    """Values near the positions *shares*, from a sketch that leaves out NaN; only where there is no other value, the largest."""
    size = min(65_535, max(8, math.ceil((2.296 * accuracy) ** (1 / 0.9021))))  # its rank error is 2.296 / size^0.9021 in 99 of 100
    near = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(value, F.lit(size)), F.array(*[F.lit(x) for x in sorted(shares)]))
    return F.when(F.count_if(value.isNotNull() & ~F.isnan(value)) > 0, near).otherwise(F.array(F.max(value)))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY, few: int = FEW) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles per column, by bracketing.

    A sketch proposes values around each wanted position; counts of the smaller
    and of the equal values then either hit the position or narrow its bracket,
    which the next round looks into.  Once at most *few* values are inside, they
    are sorted.  All passes are aggregates with buffers of bounded size: nothing
    is exploded or shuffled by value.  A round takes two passes and leaves about
    a share of 2 / *accuracy* of the values; the first counts the values as well.
    The sketch draws at random, which changes what is proposed and never the result.
    """
    cols = list(cols)
    if not cols:
        return {}
    around = lambda at: {min(1.0, max(0.0, x + e / accuracy)) for x in at for e in (-1, 0, 1)}
    asked = {(c, "n"): F.count(c) for c in cols}
    if probs:
        asked |= {(c, None, None): _proposed(F.col(c).cast("double"), around(probs), accuracy) for c in cols}
    first_round = _one_row(df, asked)
    sizes = {c: first_round[c, "n"] for c in cols}
    found: dict[tuple[str, int], float] = {}
    wanted = {(c, k): _Bracket(c, None, None, 0, n) for c, n in sizes.items() if n
              for p in probs for k in {math.floor((n - 1) * p), math.ceil((n - 1) * p)}}
    while wanted:
        few_left = {at: b for at, b in wanted.items() if b.last - b.first <= few}
        small = {(c, k): F.get(F.sort_array(F.collect_list(b.inside())), F.lit(k - b.first)) for (c, k), b in few_left.items()}
        if small:
            found |= _one_row(_holding(df, list(few_left.values())), small)
            wanted = {at: b for at, b in wanted.items() if at not in small}
        if not wanted:
            break
        shares: dict[tuple, set[float]] = {}
        for (c, k), b in wanted.items():
            shares.setdefault(b.key, set()).update(around([(k - b.first + 0.5) / (b.last - b.first)]))
        by_key = {b.key: b for b in wanted.values()}
        pivots = {key: first_round.pop(key) for key in shares if key in first_round}
        again = {key: _proposed(by_key[key].inside(), s, accuracy) for key, s in shares.items() if key not in pivots}
        pivots |= _one_row(_holding(df, [by_key[key] for key in again]), again) if again else {}
        asked = {(key, v, strict): F.count_if(by_key[key].inside() < v if strict else by_key[key].inside() <= v)
                 for key, found_here in pivots.items() for v in found_here for strict in (True, False)}
        whole = any(b.lo is None and b.hi is None for b in by_key.values())
        ranks = _one_row(df if whole else _holding(df, list(by_key.values())), asked)
        for (c, k), b in list(wanted.items()):
            lo, hi, first, last = b.lo, b.hi, b.first, b.last
            for v in sorted(set(pivots[b.key])):
                less, upto = b.first + ranks[b.key, v, True], b.first + ranks[b.key, v, False]
                if less <= k < upto:
                    found[c, k] = v
                elif upto <= k:
                    lo, first = v, upto
                elif less < last:
                    hi, last = v, less
            if (c, k) in found:
                del wanted[c, k]
            else:
                wanted[c, k] = _Bracket(c, lo, hi, first, last)
    out = {}
    for c in cols:
        n = sizes[c]
        at = [(n - 1) * p for p in probs]
        out[c] = [None if n == 0 else found[c, math.floor(x)] + (found[c, math.ceil(x)] - found[c, math.floor(x)]) * (x - math.floor(x)) for x in at]
    return out


# --- fitting, one stage after the other -----------------------------------------------------

def fit_imputer(train: DataFrame, cols: Sequence[str]) -> tuple[list[str], dict[str, float]]:
    """(columns without any value, exact medians of the others)."""
    medians = {c: v[0] for c, v in exact_quantiles(train, cols, [0.5]).items()}
    return [c for c in cols if medians[c] is None], {c: m for c, m in medians.items() if m is not None}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items()})


def fit_constants(train: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with at most one distinct value."""
    row = train.agg(*[F.min(c).eqNullSafe(F.max(c)).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def distinct_more_than(df: DataFrame, cols: Sequence[str], n: int = fv.CONTINUOUS_DISTINCT, rough: dict[str, int] | None = None) -> dict[str, bool]:
    """Whether a column has more than *n* distinct values, exactly.

    A sketch (or *rough*, its counts) settles the columns that are far above; only columns near *n*,
    whose value sets are small, are counted exactly.
    """
    cols = list(cols)
    if not cols:
        return {}
    rough = rough or df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    near = [c for c in cols if rough[c] <= 10 * n]
    exact = df.agg(*[F.size(F.collect_set(c)).alias(c) for c in near]).first() if near else {}
    return {c: (exact[c] if c in near else rough[c]) > n for c in cols}


def skewness(c: str) -> Column:
    """Sample skewness with the bias correction (0 for a constant column, NULL below three rows)."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.coalesce(F.nanvl(F.skewness(c), F.lit(0.0)), F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


def log_column_stats(train: DataFrame, cols: Sequence[str]) -> dict[str, dict]:
    """Minimum, skewness and whether the column is continuous, for columns that may be logged."""
    cols = [c for c in cols if fv.DISPLAY_NAMES.get(c, c) not in fv.NEVER_LOGGED]
    if not cols:
        return {}
    row = train.agg(*[F.struct(F.min(c).alias("low"), skewness(c).alias("skew"), F.approx_count_distinct(c).alias("rough")).alias(c) for c in cols]).first()
    many = distinct_more_than(train, cols, rough={c: row[c]["rough"] for c in cols})
    return {c: {"low": row[c]["low"], "skew": row[c]["skew"], "continuous": many[c]} for c in cols}


def fit_log_columns(train: DataFrame, cols: Sequence[str]) -> list[str]:
    """Non-negative, continuous, skewed columns."""
    stats = log_column_stats(train, cols)
    return [c for c, s in stats.items()
            if s["low"] >= 0 and s["continuous"] and abs(s["skew"] or 0.0) >= fv.SKEW_LIMIT]


def apply_log1p(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in cols})


def fit_clip(train: DataFrame, cols: Sequence[str], quantiles=fv.CLIP_QUANTILES) -> dict[str, tuple[float, float]]:
    """Clip bounds of the continuous columns (after the log step)."""
    cols = [c for c in cols if fv.DISPLAY_NAMES.get(c, c) not in fv.NEVER_LOGGED]
    many = distinct_more_than(train, cols)
    found = exact_quantiles(train, [c for c in cols if many[c]], quantiles)
    return {c: (v[0], v[1]) for c, v in found.items()}


def apply_clip(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)) for c, (lo, hi) in bounds.items()})


#: Pairs of columns in one aggregate: the plan and its code grow with them, the passes over the rows fall.
CORRELATIONS = 300


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column with each earlier one, as rows (a, b, r): one aggregate for each *CORRELATIONS* pairs."""
    pairs = [(a, b) for j, b in enumerate(cols) for a in cols[:j]]
    parts = []
    for lo in range(0, len(pairs), CORRELATIONS):
        part = pairs[lo:lo + CORRELATIONS]
        row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(part)])
        entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(part)]
        parts.append(row.select(F.explode(F.array(*entries)).alias("e")).select("e.*"))
    return functools.reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], "a string, b string, r double")


def fit_correlated(train: DataFrame, cols: Sequence[str], limit: float = fv.CORRELATION_LIMIT) -> list[str]:
    """Columns too similar to any earlier column (also to one that is itself dropped)."""
    r = {(x["a"], x["b"]): x["r"] for x in correlation_matrix(train, cols).collect()}  # one row per pair of columns
    high = {b for (a, b), v in r.items() if v is not None and abs(v) > limit}
    return [c for c in cols if c in high]


def select_k_best(scores: DataFrame, k: int = fv.SELECTED_FEATURES) -> DataFrame:
    """The *k* best (feature, score) rows with the original position kept (``pos`` breaks ties)."""
    rank = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("score"), "pos"))  # one row per feature
    return scores.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def fit_robust(train: DataFrame, cols: Sequence[str], quantiles=fv.SCALE_QUANTILES) -> dict[str, tuple[float, float]]:
    """(median, interquartile range) per column; a zero range becomes 1."""
    found = exact_quantiles(train, cols, [quantiles[0], 0.5, quantiles[1]])
    return {c: (mid, (hi - lo) or 1.0) for c, (lo, mid, hi) in found.items()}


def apply_robust(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scales.items()})


def not_finite(cols: Sequence[str]) -> Column:
    """True when any of the columns is missing, NaN or infinite."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return bad


def assert_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows as they are; a value that is not finite stops the job."""
    stop = F.when(not_finite(cols), F.raise_error(F.lit("non-finite value after preprocessing")).cast("boolean")).otherwise(F.lit(True))
    return df.filter(stop)


# --- the fitted chain ------------------------------------------------------------------------

@dataclass
class Params:
    """Everything learned on the train part, in application order."""

    inputs: list[str]
    all_null: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    constants: list[str] = field(default_factory=list)
    logged: list[str] = field(default_factory=list)
    clip: dict[str, tuple[float, float]] = field(default_factory=dict)
    correlated: list[str] = field(default_factory=list)
    selected: list[str] = field(default_factory=list)
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    classes: list[str] = field(default_factory=list)
    version: int = fv.PREPROCESSING_VERSION
    fitted_on: str = "train"
    fit_rows: int = 0
    fit_hash: str = ""

    @property
    def surviving(self) -> list[str]:
        gone = {*self.all_null, *self.constants, *self.correlated}
        return [c for c in self.inputs if c not in gone]


def fit_summary(rows: DataFrame, cols: Sequence[str]) -> dict:
    """Number and order-free hash of the rows a fit reads, as parameters of the fit."""
    found = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cols, fv.TARGET).cast("decimal(20,0)")).cast("string").alias("h")).first()
    return {"fit_rows": found["n"], "fit_hash": found["h"] or "0"}


def check_no_leakage(p: Params, train: DataFrame) -> None:
    """Stop when the parameters were fitted on other rows than those of the train part."""
    if fit_summary(train, p.inputs) != {"fit_rows": p.fit_rows, "fit_hash": p.fit_hash}:
        raise ValueError("the parameters were fitted on other rows than the train part")


def fit_preprocessor(
    train: DataFrame, cols: Sequence[str], k: int = fv.SELECTED_FEATURES, score=None,
) -> Params:
    """Fit every stage on *train* (columns of doubles plus ``Label``), each on the output of the stage before.

    *score* maps (df, columns) to a DataFrame (feature, score); the default is
    binned mutual information with the label.
    """
    from flowloom.operators.mutual_info import mutual_information

    cols = list(cols)
    p = Params(inputs=cols, classes=fit_label_index(train), **fit_summary(train, cols))
    p.all_null, p.medians = fit_imputer(train, cols)
    work = [c for c in cols if c not in p.all_null]
    df = impute(train, p.medians)
    p.constants = fit_constants(df, work)
    work = [c for c in work if c not in p.constants]
    p.logged = fit_log_columns(df, work)
    df = apply_log1p(df, p.logged)
    p.clip = fit_clip(df, work)
    df = apply_clip(df, p.clip)
    p.correlated = fit_correlated(df, work)
    work = [c for c in work if c not in p.correlated]
    score = score or (lambda d, c: mutual_information(d, c, fv.TARGET, method="binned"))
    if len(work) > k:
        pos = {c: i for i, c in enumerate(work)}
        scored = [(r["feature"], float(r["score"]), pos[r["feature"]]) for r in score(df, work).collect()]
        best = sorted(scored, key=lambda s: (-s[1], s[2]))[:k]
        chosen = {s[0] for s in best}
        p.selected = [c for c in work if c in chosen]
    else:
        p.selected = work
    p.scale = fit_robust(df, p.selected)
    return p


def apply_fitted(df: DataFrame, p: Params) -> DataFrame:
    """The fitted chain on already numeric columns: the selected columns scaled, all others kept."""
    df = impute(df, p.medians)
    df = apply_log1p(df, p.logged)
    return apply_robust(apply_clip(df, p.clip), p.scale)


def _scaled(c: str, p: Params, value: Column) -> Column:
    x = F.coalesce(value, F.lit(p.medians[c]))
    if c in p.logged:
        x = F.log1p(F.greatest(x, F.lit(0.0)))
    if c in p.clip:
        lo, hi = p.clip[c]
        x = F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    mid, width = p.scale[c]
    return (x - F.lit(mid)) / F.lit(width)


def _checked(df: DataFrame, p: Params) -> DataFrame:
    """Per input: ``_p_`` its number, ``_m_`` whether it is missing, ``_x_`` whether it is rejected.

    Missing: absent, or negative where that is impossible.  Rejected: present
    but unreadable, not finite, or a port out of range.  Two projections, so
    each value is parsed once.
    """
    types = dict(df.dtypes)
    name = lambda c: fv.DISPLAY_NAMES.get(c, c)
    parsed = df.withColumns({
        f"_p_{c}": finite_number(c, types[c] == "string") if c in types else F.lit(None).cast("double") for c in p.inputs})
    flags = {}
    for c in p.inputs:
        raw, value = (F.col(c) if c in types else F.lit(None)), F.col(f"_p_{c}")
        gone = raw.isNull()
        if name(c) in fv.SCORING_NONNEGATIVE:
            gone = gone | F.coalesce(value < 0, F.lit(False))
        bad = raw.isNotNull() & value.isNull()
        if name(c) in fv.PORT_COLUMNS:
            bad = bad | F.coalesce(~value.between(0, 65535), F.lit(False))
        flags |= {f"_m_{c}": gone, f"_x_{c}": bad}
    return parsed.withColumns(flags)


def _listed(prefix: str, cols: Sequence[str]) -> Column:
    """Names of the columns whose flag is set."""
    names = [F.when(F.col(f"{prefix}{c}"), F.lit(c)) for c in cols]
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def validate_features(df: DataFrame, p: Params) -> DataFrame:
    """Add ``missing_fields`` and ``rejected_fields``."""
    checked = _checked(df, p)
    return checked.select(*df.columns, _listed("_m_", p.inputs).alias("missing_fields"), _listed("_x_", p.inputs).alias("rejected_fields"))


def transform(df: DataFrame, p: Params, keep: Sequence[str] | None = None) -> DataFrame:
    """Raw flow features -> scaled float vector with field diagnostics, map-only.

    Adds ``vector`` (NULL when not finite), ``feature_quality``,
    ``missing_fields``, ``imputed_fields``, ``rejected_fields``, ``success``
    and ``error``.
    """
    keep = list(df.columns if keep is None else keep)
    off = lambda c: F.col(f"_m_{c}") | F.col(f"_x_{c}")
    out = _checked(df, p)
    out = out.withColumns({f"_s_{c}": _scaled(c, p, F.when(~off(c), F.col(f"_p_{c}"))).cast("float") for c in p.selected})
    surviving = p.surviving
    n_bad = sum((off(c).cast("int") for c in surviving), F.lit(0))
    out = out.withColumns({"_bad": n_bad, "success": ~not_finite([f"_s_{c}" for c in p.selected])})
    quality = (
        F.when(~F.col("success"), "INVALID").when(F.col("_bad") == 0, "COMPLETE")
        .when(F.col("_bad") / max(len(surviving), 1) >= fv.DEGRADED_SHARE, "DEGRADED").otherwise("PARTIAL"))
    imputed = [F.when(off(c), F.lit(c)) for c in p.inputs if c in p.medians]
    return out.select(
        *keep, F.when(F.col("success"), F.array(*[F.col(f"_s_{c}") for c in p.selected])).alias("vector"), quality.alias("feature_quality"),
        _listed("_m_", p.inputs).alias("missing_fields"), F.array_compact(F.array(*imputed)).alias("imputed_fields"),
        _listed("_x_", p.inputs).alias("rejected_fields"), "success",
        F.when(F.col("success"), "").otherwise("Non-finite value survived preprocessing").alias("error"))


# --- parameters as a table -----------------------------------------------------------------------

def params_rows(p: Params) -> list[tuple[str, str, str, float | None]]:
    """(feature, stage, param, value) rows of the fitted numbers and choices."""
    rows = [(c, "impute", "median", float(m)) for c, m in p.medians.items()]
    rows += [(c, "drop", stage, None) for stage in ("all_null", "constants", "correlated") for c in getattr(p, stage)]
    rows += [(c, "log", "log1p", None) for c in p.logged]
    rows += [(c, "clip", n, float(v)) for c, b in p.clip.items() for n, v in zip(("lower", "upper"), b)]
    rows += [(c, "select", "position", float(i)) for i, c in enumerate(p.selected)]
    rows += [(c, "scale", n, float(v)) for c, b in p.scale.items() for n, v in zip(("median", "width"), b)]
    return rows


def params_table(spark: SparkSession, p: Params) -> DataFrame:
    return spark.createDataFrame(params_rows(p), "feature string, stage string, param string, value double")


def save_params(spark: SparkSession, p: Params, path: str) -> None:
    """Write the parameters as one JSON document (through Spark, so any shared storage works)."""
    spark.createDataFrame([(json.dumps(asdict(p), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_params(spark: SparkSession, path: str) -> Params:
    """Read parameters back; stops on another version, a fit that saw test rows, or a wrong shape."""
    raw = json.loads("".join(r[0] for r in spark.read.text(path).collect()))
    if raw.get("version") != fv.PREPROCESSING_VERSION:
        raise ValueError(f"parameters have version {raw.get('version')}, expected {fv.PREPROCESSING_VERSION}")
    if raw.get("fitted_on") != "train":
        raise ValueError("parameters were not fitted on the train part alone")
    pairs = lambda d: {k: tuple(v) for k, v in d.items()}
    p = Params(**{**raw, "clip": pairs(raw["clip"]), "scale": pairs(raw["scale"])})
    if set(p.selected) - set(p.surviving) or set(p.selected) != set(p.scale):
        raise ValueError("selected features do not match the fitted stages")
    return p

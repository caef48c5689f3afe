"""Text quality by regularised quadratic discriminant analysis.

A text becomes a vector of transformed statistics.  Each class has a mean and a
covariance that is shrunk towards the pooled covariance and a multiple of the
identity; the score is the logistic of the difference of the two log densities
(Mahalanobis terms by cached Cholesky factors) plus the log prior odds.

Fitting reads at most ``per_class`` labelled documents of each class, chosen by
hash.  Rows: a null text is empty and scored like an empty text; texts are read
whole; equal rows get equal scores; without rows of both classes every score is
0.5; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import bounded_sample, stored

PER_CLASS = 5000
#: Shares of the pooled covariance and of the identity in a class covariance.
POOL, RIDGE = 0.3, 0.05
FEATURES = ("log_words", "word_length", "distinct", "symbols", "bang", "bar", "upper", "digits", "punctuation", "line_words", "repeated_lines", "longest_word", "common")

_KIND = np.zeros((256, 8), dtype=np.float64)
for _b in b"#*$%&<>@^~=_{}[]\\+":
    _KIND[_b, 0] = 1
_KIND[ord("!"), 1] = 1
_KIND[ord("|"), 2] = 1
_KIND[65:91, 3] = 1
_KIND[48:58, 4] = 1
for _b in b".,;:?'\"()-/":
    _KIND[_b, 5] = 1
_KIND[97:123, 6] = 1
_KIND[192:256, 7] = 1  # first bytes of longer characters


def features(text: str | None) -> np.ndarray:
    """The transformed statistics of a text: logarithms of counts and of rates, all finite for any text."""
    t = text or ""
    raw = t.encode("utf-8", "surrogatepass")
    kinds = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _KIND
    words = t.split()
    n = len(words)
    chars = max(1.0, float(len(t)))
    lines = [x for x in t.split("\n") if x.strip()]
    distinct = len(set(words))
    upper = sum(1 for c in re.findall(r"[^\W\d_]{2,}", t) if c.isupper()) if n else 0
    rate = lambda k: np.log(1e-4 + k / chars)
    return np.array([
        np.log1p(n), np.log1p(chars / max(1, n)), distinct / max(1.0, n) if n else 0.0, rate(kinds[0]), rate(kinds[1]), rate(kinds[2]),
        np.log(1e-3 + upper / max(1, n)), rate(kinds[4]), rate(kinds[5]), np.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0, np.log1p(max(map(len, words), default=0)), np.log1p(distinct) - 0.5 * np.log1p(n)])


def feature_rows(docs: DataFrame, held_out: Column) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = np.stack([features(t.as_py()) for t in batch.column(2)]) if batch.num_rows else np.empty((0, len(FEATURES)))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["doc_id", "held_out", "x"])
    return (docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, held_out boolean, x array<double>"))


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse Cholesky factor of the covariance, log determinant; log prior odds of class 1; scale of the features."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple
    factors: tuple
    logdets: tuple
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Score of each row; rows are held to ten deviations from the centre, where densities say nothing any more."""
        if not self.means:
            return np.full(len(x), 0.5)
        z = np.clip((x - self.centre) / self.scale, -10, 10)
        density = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pool: float = POOL, ridge: float = RIDGE) -> Discriminant:
    if len(set(y.tolist())) < 2:
        return Discriminant(np.zeros(1), np.ones(1), (), (), (), 0.0)
    centre = x.mean(axis=0)
    scale = np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - centre) / scale, -10, 10)
    parts = [z[y == c] for c in (0, 1)]
    own = [np.cov(p, rowvar=False, bias=True) for p in parts]
    pooled = sum(len(p) * s for p, s in zip(parts, own)) / len(z)
    means, factors, logdets = [], [], []
    for p, s in zip(parts, own):
        cov = (1 - pool) * s + pool * pooled
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / len(cov) * np.eye(len(cov)) + 1e-9 * np.eye(len(cov))
        lower = np.linalg.cholesky(cov)
        means.append(p.mean(axis=0))
        factors.append(np.linalg.inv(lower))
        logdets.append(2 * float(np.log(np.diag(lower)).sum()))
    return Discriminant(centre, scale, tuple(means), tuple(factors), tuple(logdets), float(np.log(len(parts[1]) / len(parts[0]))))


def fit_labelled(rows: DataFrame, labelled: DataFrame, label: str, per_class: int = PER_CLASS) -> Discriminant:
    """Fit on feature rows (doc_id, x) of at most *per_class* labelled documents of each class."""
    sample = bounded_sample(labelled.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)"), "y", per_class)
    # of a doc_id that repeats with other texts the least feature row counts, so that reruns agree
    got = rows.select("doc_id", "x").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("r.x", "r.y").collect()
    return fit(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["y"] for r in got], dtype=int))


def quality_scores(docs: DataFrame, labelled: DataFrame, label: str, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted per row of *docs*; *labelled* holds the rows that may be learnt from."""
    rows = stored(feature_rows(docs, held_out), "features")
    model = docs.sparkSession.sparkContext.broadcast(fit_labelled(rows, labelled, label))

    def run(batches):
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            s = model.value.scores(flat.reshape(batch.num_rows, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

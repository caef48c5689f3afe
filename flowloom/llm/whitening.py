"""Embedding whitening by QDWH spectral divide and conquer.

The fit list is every distinct integer vector once.  Spark sums it up (exact
integer sums, then products of centred entries, partial per task and added by a
grouped sum); what reaches the driver is the d x d covariance, whatever the
number of rows.  There the spectrum is divided: the polar factor U of the
shifted covariance V - s I, by the QR form of the dynamically weighted Halley
iteration, gives the projector (U + I) / 2 onto the eigenvectors above s.
Orthonormal bases of its range and of the rest split V into two smaller
problems, down to single vectors (or blocks that are a multiple of the identity).
The d x k model then goes out with the tasks' closure and every row is whitened
where it is.

Defined results: vectors that are null, hold null, NaN or infinite entries or an
entry of magnitude 2**46 and more are dropped.  Of vectors of several lengths the
most frequent length is whitened (ties: the longer one), the others are dropped
likewise; vectors without entries have no components.  Rows that repeat count
once in the fit and are each answered.  Directions without variance (rank below d)
have no component, so a table of one vector gives no rows, as an empty one does.
``deviation`` is null where it exceeds a 64-bit integer.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import stored

#: Entries of this magnitude and more are treated as infinite: integers stay exact in a double.
LARGEST = float(2**46)


def _usable(vector: str) -> Column:
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST)), F.lit(False))


def integer_vectors(vectors: DataFrame, key: str, vector: str, scale: int, offset: int) -> DataFrame:
    """(key, x) of the usable vectors of the most frequent length, x = floor(scale * entry) + offset."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * float(scale)) + F.lit(offset).cast("long"))
    rows = vectors.where(_usable(vector)).select(F.col(key).alias("key"), x.alias("x"))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (common["d"] if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n as doubles, by the integer n * x - S."""
    return _deviations(x, n, sums).astype(np.float64) / n


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, in 64 bits where they hold it, else in Python's integers."""
    fits = max(n * int(np.abs(x).max(initial=0)), *map(abs, sums), 0) < 2**61
    kind = np.int64 if fits else object
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of every dimension."""
    def partial(batches):
        total, n = None, 0
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(0))
            # entries are below 2**53, so sums of 2**10 rows fit in 64 bits
            sums = [x[b:b + 2**10].sum(axis=0).tolist() for b in range(0, len(x), 2**10)]
            part = [sum(v) for v in zip(*sums, strict=True)]
            total = part if total is None else [p + q for p, q in zip(total, part, strict=True)]
            n += len(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([str(v) for v in total]), pa.array([n] * len(total), pa.int64())], names=["i", "s", "n"])

    rows = (fit.mapInArrow(partial, "i int, s string, n long").groupBy("i")
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect())
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


def _products(fit: DataFrame, values, size: int) -> np.ndarray:
    """Sum over the fit list of the outer products of values(x): added per task, then by a grouped sum over size * size cells."""
    def partial(batches):
        total = np.zeros((size, size))
        for batch in batches:
            if len(batch):
                y = values(_matrix(batch.column(0)))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    cells = fit.mapInArrow(partial, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    for r in cells.collect():
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a square matrix by the QR form of the dynamically weighted Halley iteration."""
    m = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    low = 1e-16  # bound of the smallest singular value; one that is too small only costs an iteration
    for _ in range(30):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(m)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:m] @ q[m:].T
        low = min(low * (wa + wb * low**2) / (1 + wc * low**2), 1 - 1e-16)
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= 1e-15 * m**0.5 and low > 0.5:
            break
    return x


def _split(a: np.ndarray, shift: float, floor: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces of symmetric *a* above and below the shift; None where the shift does not part them cleanly."""
    m = len(a)
    u = polar(a - shift * np.eye(m))
    projector = ((u + u.T) / 2 + np.eye(m)) / 2
    rank = round(float(np.trace(projector)))
    if not 0 < rank < m:
        return None
    start = np.random.default_rng(m).standard_normal((m, rank))
    basis, _ = np.linalg.qr(projector @ start)
    for _ in range(2):
        basis, _ = np.linalg.qr(projector @ basis)
    whole, _ = np.linalg.qr(basis, mode="complete")
    rest = whole[:, rank:]
    return (basis, rest) if np.linalg.norm(rest.T @ a @ basis) <= floor else None


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by recursive spectral division."""
    d = len(v)
    if not d:
        return np.zeros(0), np.zeros((0, 0))
    scale = np.linalg.norm(v)
    floor = 1e-15 * d * scale
    values, vectors = [], []
    open_ = [np.eye(d)]
    while open_:
        basis = open_.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        m, mean = len(a), float(np.trace(a)) / len(a)
        spread = np.linalg.norm(a - mean * np.eye(m))
        if m == 1 or spread <= floor:
            values += [float(x) for x in np.diag(a)]
            vectors += list(basis.T)
            continue
        # The mean parts every block that is not a multiple of the identity; the others guard against a shift that meets an eigenvalue.
        shifts = [float(np.median(np.diag(a))), mean, *[mean + spread / m**0.5 * f for f in (0.1, -0.1, 0.3, -0.3, 0.03, -0.03, 0.01, -0.01)]]
        parts = next(filter(None, (_split(a, s, floor) for s in shifts)), None) or next(filter(None, (_split(a, s, 1e3 * floor) for s in shifts)), None)
        if parts is None:
            raise ArithmeticError(f"no shift parts a block of {m} components")
        open_ += [np.linalg.qr(basis @ p)[0] for p in parts]
    order = np.argsort(-np.array(values), kind="stable")
    vectors, _ = np.linalg.qr(np.array(vectors).T[:, order])
    return np.einsum("ij,ij->j", vectors, v @ vectors), vectors


@dataclass
class Whitener:
    """What is needed to whiten a vector: bounded by the number of dimensions, whatever the number of rows."""

    n: int
    sums: list[int]
    weights: np.ndarray  # dimensions x components, eigenvectors over the root of their eigenvalues
    explained: np.ndarray
    identity_error: float


def fit_whitener(fit: DataFrame, components: int) -> Whitener:
    """Whitener of the distinct vectors *fit* (x array<long>), for as many components as have variance, up to *components*."""
    n, sums = _sums(fit)
    d = len(sums)
    v = _products(fit, lambda x: _centred(x, n, sums), d) / max(n, 1)
    values, vectors = spectrum(v)
    kept = int((values[:components] > 1e-13 * max(d, 1) * max(values[:1].max(initial=0), 0)).sum()) if n > 1 else 0
    weights = vectors[:, :kept] / np.sqrt(values[:kept])
    error = 0.0
    if kept:
        whitened = _products(fit, lambda x: _centred(x, n, sums) @ weights, kept) / n
        error = float(np.abs(whitened - np.eye(kept)).max())
    return Whitener(n, sums, weights, values[:kept] / np.trace(v) if kept else np.zeros(0), error)


def apply_whitener(rows: DataFrame, model: Whitener, key: str) -> DataFrame:
    """One row per row of *rows* (key, x) and component."""
    kept = model.weights.shape[1]

    def work(batches):
        for batch in batches:
            if not kept or not len(batch):
                continue
            x = _matrix(batch.column(1))
            off = _deviations(x, model.n, model.sums)
            small = off.dtype != object and float(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < 2**62
            squares = (off**2).sum(axis=1).tolist() if small else [sum(int(v) ** 2 for v in r) for r in off]
            squares = pa.array([s if s < 2**63 else None for s in squares], pa.int64())
            each = np.repeat(np.arange(len(x)), kept)
            white = (off.astype(np.float64) / model.n) @ model.weights
            total = len(each)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                pa.array(np.full(total, model.n)), squares.take(pa.array(each)), pa.array(white.ravel()),
                pa.array(np.tile(model.explained, len(x))), pa.array(np.full(total, model.identity_error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "x").mapInArrow(
        work, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Fit on the distinct integer vectors of the table and whiten every row: see the module's docstring."""
    rows = integer_vectors(vectors, key, vector, scale, offset)
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    return apply_whitener(rows, fit_whitener(fit, components), key)

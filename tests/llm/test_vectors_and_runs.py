"""Whitening, periodic runs and top-k search against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowloom.llm import runs, topk, whitening
from flowloom.llm.common import SPACES

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int"


def brute_runs(w, least=12):
    """Every maximal stretch of every lag, its smallest period tried one by one."""
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s = w[i:j + q]
            if j > i and len(s) >= max(least, 2 * q) and not any(s[p:] == s[:-p] for p in range(1, q)):
                out.append((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    return [x for i, x in enumerate(w) if not any(a + q <= i < a + n for a, n, q in found)]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 4)):
            n, letters = rng.randint(0, 120), rng.choice([1, 2, 3, 5])
            w = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        flat = np.array([x for k, w in enumerate(docs) for x in [*w, -2 - k]])
        part = np.repeat(np.arange(len(docs)), [len(w) + 1 for w in docs])
        starts = np.cumsum([0, *[len(w) + 1 for w in docs]])
        want = [(int(starts[k]) + a, int(starts[k]) + a + n, q) for k, w in enumerate(docs) for a, n, q in brute_runs(w)]
        assert sorted(runs.runs_of(flat, part)) == sorted(want)


def test_long_repetitive_texts_stay_cheap():
    for w in ([0] * 300_000, [0, 1] * 150_000):
        assert len(runs.runs_of(np.array([*w, -2]), np.zeros(len(w) + 1, dtype=int))) == 1


def test_runs_query(spark):
    got = {r.doc_id: r for r in entry.queries()["op12_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue  # brute force is quadratic; the SQL check covers these
        found = brute_runs(w)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *(best or (None, None, None)))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(collapsed(w, found)).encode()).hexdigest()


def test_runs_edges(spark):
    again = "x y z " * 5
    rows = [(1, None), (2, ""), (3, " \t\r\n"), (4, again), (4, again), (None, again), (5, "w\xa0w " * 20), (6, "a " * 50_000)]
    docs = spark.createDataFrame([(*r, 9, [1]) for r in rows], "doc_id long, text string, runs int, collapsed array<int>")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find(docs).collect()]
    assert sorted(got[:3]) == [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], "")]
    assert got[3:6] == [(4, 15, [(0, 15, 3)], "x y z")] * 2 + [(None, 15, [(0, 15, 3)], "x y z")]
    assert got[6][1:] == (20, [(0, 20, 1)], "w\xa0w") and got[7][1:] == (50_000, [(0, 50_000, 1)], "a")
    new = runs.collapse(docs).collect()
    assert [r.text for r in new] == [None, "", " \t\r\n", "x y z", "x y z", "x y z", "w\xa0w", "a"] and all(r.runs == 9 and r.collapsed == [1] for r in new)
    assert runs.find(docs.limit(0)).count() == 0
    assert runs.digests(runs.find(runs.planted(docs, SPACES))).count() == len(rows)


def whitened_by_numpy(x):
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    return fit, np.linalg.eigh(centred.T @ centred / len(fit))


def test_spectrum_equals_eigh():
    rng = np.random.default_rng(1)
    cases = [np.zeros((3, 3)), np.eye(4), np.diag([1.0] * 5 + [2.0] * 5), np.array([[2.0, 1.0], [1.0, 2.0]])]
    for d in (7, 40, 64):
        b = rng.standard_normal((d // 2 if d == 40 else 3 * d, d))
        cases.append(b.T @ b)
        q, _ = np.linalg.qr(b.T @ b + np.eye(d))
        cases.append(q @ np.diag(np.logspace(4, -4, d)) @ q.T)
    for a in cases:
        a = (a + a.T) / 2
        values, vectors = whitening.spectrum(a)
        size = max(np.linalg.norm(a), 1e-300)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-13 * size)
        assert np.linalg.norm(vectors.T @ vectors - np.eye(len(a))) < 1e-13 * len(a)
        assert np.linalg.norm(a @ vectors - vectors * values) < 1e-13 * size


def test_polar_factor():
    a = np.random.default_rng(2).standard_normal((20, 20))
    u, _, vt = np.linalg.svd(a)
    assert np.allclose(whitening.polar(a), u @ vt, atol=1e-12)


def test_whitening_query(spark):
    got = entry.queries()["op11_whitening"](spark, SF).toPandas()
    raw = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().set_index("vec_id")["embedding"]
    x = {k: np.floor(64 * np.array(v, dtype=float)).astype(int) + 10**6 for k, v in raw.items()}
    fit, (values, vectors) = whitened_by_numpy(np.array(list(x.values())))
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    assert (got["n"] == n).all() and len(got) == 16 * len(x) and got["identity_error"].max() < 1e-10
    first = got[got["component"] == 1]
    for r in first.itertuples():
        assert r.deviation == sum((n * int(v) - s) ** 2 for v, s in zip(x[r.vec_id], sums, strict=True))
    for c in range(1, 17):
        mine = got[got["component"] == c].set_index("vec_id")
        want = np.array([(x[k] - fit.mean(axis=0)) @ vectors[:, -c] / values[-c] ** 0.5 for k in mine.index])
        have = mine["whitened"].to_numpy()
        assert np.allclose(have, want * np.sign(have @ want), atol=1e-6)
        assert np.allclose(mine["explained"], values[-c] / values.sum(), rtol=1e-9)


def test_whitening_edges(spark):
    good = [(i, [float((i * 7) % 5), float(i % 3), 1.0], 0) for i in range(30)]
    bad = [(100, None, 0), (101, [1.0, None, 2.0], 0), (102, [1.0, float("nan"), 2.0], 0), (103, [1.0, float("inf"), 2.0], 0), (104, [], 0), (105, [1.0], 0)]
    df = spark.createDataFrame(good + good[:5] + bad, VECTORS).withColumn("component", F.lit("x")).withColumn("x", F.lit(1))
    got = whitening.whiten(df).collect()
    assert {r.component for r in got} == {1, 2}  # the third entry never varies
    assert len(got) == 2 * 35 and {r.n for r in got} == {15} and max(r.identity_error for r in got) < 1e-12
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 3")).count() == 0
    huge = spark.createDataFrame([(i, [1e12 * (i % 3), float(i)], 0) for i in range(9)], "vec_id long, embedding array<double>, label int")
    wide = whitening.whiten(huge).collect()
    assert len(wide) == 9 and all(r.deviation is None for r in wide if r.vec_id % 3 != 1)


def brute_topk(rows, k=5, divisor=50):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    width = max((len(v) for _, v in rows), default=0)
    x = np.array([[*v, *[0] * (width - len(v))] for _, v in rows], dtype=np.int64).reshape(len(rows), width)
    out = []
    for a, (i, _) in enumerate(rows):
        if i % divisor == 0:
            score = x @ x[a]
            order = sorted((-int(s), rows[b][0]) for b, s in enumerate(score) if b != a)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(order, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clustered", "uniform", "norms", "copies", "ties"])
def test_topk_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_QUERIES", 7)
    monkeypatch.setattr(topk, "SLOT_POINTS", 100)
    monkeypatch.setattr(topk, "CHUNK", 40)
    rng = np.random.default_rng(7)
    n, d = 700, 8
    v = rng.standard_normal((n, d))
    if kind == "clustered":
        v = v * 0.02 + rng.standard_normal((20, d))[np.arange(n) % 20]
    if kind == "norms":
        v *= rng.exponential(3, (n, 1))
    if kind == "copies":
        v[: n // 3] = v[0]
        v[n // 3: n // 2] = v[np.arange(n // 3, n // 2) // 4]
    if kind == "ties":
        v = rng.integers(-1, 2, (n, d)).astype(float)
    rows = [(i, [float(np.float32(c)) for c in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame([(i, r, 0) for i, r in rows], VECTORS)
    got = topk.search(df, F.col("vec_id") % 10 == 0).collect()
    want = brute_topk([(i, [int(np.floor(256 * c)) for c in r]) for i, r in rows], divisor=10)
    assert sorted(tuple(r) for r in got) == want


def test_topk_prunes(spark):
    """Queries near one of two far clusters get the points of that cluster only."""
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(100, 1, (500, 4)), rng.normal(-100, 1, (500, 4))]
    space = topk._Space(np.zeros((0, 0)), float((x**2).sum(axis=1).max()))
    space.pivots = space.lift(x[[0, 500]], np.zeros(2, dtype=bool))
    d = space.distances(space.lift(x, np.zeros(1000, dtype=bool)))
    ask = space.distances(space.lift(x[:20], np.ones(20, dtype=bool)))[:, 0]
    groups = topk._bounds({0: sorted(d[:500, 0])[:6], 1: sorted(d[500:, 1])[:6]}, {0: (20, float(ask.max()))}, space, 5, 1000)
    assert (d[:500, 0] <= groups.reach[0]).sum() > 5 and not (d[500:, 0] <= groups.reach[0]).any()


def test_topk_edges(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 1.0]), (50, [1.0]), (100, []), (7, [2.0, 2.0, 2.0]), (8, [0.0, 0.0])]
    bad = [(9, None), (10, [None, 1.0]), (11, [float("nan")]), (12, [float("-inf")]), (None, [1.0, 1.0]), (13, [3e38])]
    df = spark.createDataFrame([(i, v, None) for i, v in rows + bad], VECTORS).withColumn("rank", F.lit("x")).withColumn("h1", F.lit(1))
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute_topk([(i, [int(256 * c) for c in v]) for i, v in rows])
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(df.where("vec_id = 0 and embedding[0] = 1"), F.col("vec_id") % 50 == 0).count() == 0  # one row, no candidate
    assert topk.search(df, F.lit(False)).count() == 0

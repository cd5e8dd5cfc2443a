"""Whitening against exact fractions and another eigensolver; sums that are whole whatever the partitions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def sound(vectors):
    return [(i, v) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def brute(vectors):
    """(n, S, covariance in fractions, {vec_id: [deviations]}) by plain loops."""
    rows = [(i, [math.floor(1024 * float(x)) + 100_000 for x in v]) for i, v in sound(vectors)]
    n, d = len(rows), len(rows[0][1])
    total = [sum(x[k] for _, x in rows) for k in range(d)]
    centred = [[Fraction(n * x[k] - total[k], n) for k in range(d)] for _, x in rows]
    v = [[sum(c[i] * c[j] for c in centred) / n for j in range(d)] for i in range(d)]
    deviations = sorted((i, sum((n * x[k] - total[k]) ** 2 for k in range(d))) for i, x in rows)
    return n, total, v, deviations


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["component"]) for k, v in out.items()}


@pytest.mark.parametrize("d", [1, 2, 7, 12])
def test_op12_brute(spark, d):
    rng = random.Random(d)
    vectors = [(n, [rng.gauss(k, 0.01 + k) for k in range(d)]) for n in range(60)] + [(100, None), (101, [math.nan] * d), (102, [None] * d), (103, [math.inf] * d)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
    n, total, v, deviations = brute(vectors)
    values, basis = np.linalg.eigh(np.array([[float(x) for x in row] for row in v]))
    got = collected(whitening.whiten(df))
    assert sorted((i, rows[0]["deviation"]) for i, rows in got.items()) == deviations
    assert all([r["component"] for r in rows] == list(range(1, min(8, d) + 1)) for rows in got.values())
    x = {i: np.array([math.floor(1024 * c) + 100_000 for c in vec]) for i, vec in sound(vectors)}
    trace = float(sum(v[k][k] for k in range(d)))
    for k in range(min(8, d)):
        e, u = values[::-1][k], basis[:, ::-1][:, k]
        want = np.array([(x[i] - np.array(total) / n) @ u / math.sqrt(e) for i in sorted(got)])
        have = np.array([got[i][k]["whitened"] for i in sorted(got)])
        assert np.allclose(have, want, atol=1e-9) or np.allclose(have, -want, atol=1e-9)
        assert all(abs(rows[k]["explained"] - e / trace) < 1e-12 for rows in got.values())
    errors = {r["identity_error"] for rows in got.values() for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-10
    assert {r["n"] for rows in got.values() for r in rows} == {n}


def test_op12_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in rows.collect()]
    n, _, v, deviations = brute(vectors)
    got = collected(queries.QUERIES["op12_whitening"](spark, SF))
    assert sorted((i, x[0]["deviation"]) for i, x in got.items()) == deviations and len(got) == n
    w = np.array([[r["whitened"] for r in got[i]] for i in sorted(got)])
    assert np.abs(w.T @ w / n - np.eye(8)).max() < 1e-10 and abs(w.mean(axis=0)).max() < 1e-10
    assert next(iter(got.values()))[0]["identity_error"] == pytest.approx(np.abs(np.cov(w.T, bias=True) - np.eye(8)).max(), abs=1e-12)
    values = np.linalg.eigvalsh(np.array([[float(x) for x in row] for row in v]))[::-1]
    assert np.allclose([r["explained"] for r in next(iter(got.values()))], values[:8] / values.sum(), rtol=1e-12)


def test_op12_covariance_is_exact(spark):
    """Partitions and orders change nothing, not the last bit; nor do means far from zero."""
    rng = random.Random(3)
    vectors = [(n, [1e6 + rng.gauss(0, 1e-2), rng.gauss(0, 1), -3e8 * rng.random(), rng.random() * 1e-3]) for n in range(40)]
    n, total, v, _ = brute(vectors)
    want = np.array([[float(x) for x in row] for row in v])
    for parts in (1, 7):
        rng.shuffle(vectors)
        df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(parts)
        assert whitening.sums(df) == (n, total)
        assert (whitening.covariance(df, n, total) == want).all()


def test_op12_odd_rows(spark):
    """Nulls, empty and other lengths, repeated rows and ids, huge entries, constant dimensions, columns that clash."""
    rng = random.Random(4)
    good = [(n, [rng.gauss(0, 1), rng.gauss(0, 1), 5.0]) for n in range(20)]
    rows = [*good, good[0], (None, good[1][1]), (3, [1.0, 2.0, 5.0]), (50, []), (51, [1.0]), (52, [1.0] * 4), (53, None), (54, [1.0, None, 2.0]), (55, [-math.inf, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for extra in ("n", "w", "component", "d", "i", "j", "total", "deviation", "at"):
        df = df.withColumn(extra, F.lit("7"))
    got = whitening.whiten(df).collect()
    assert len(got) == 3 * 23 and {r["n"] for r in got} == {23}
    assert sum(r["vec_id"] is None for r in got) == 3 and sum(r["vec_id"] == 0 for r in got) == 6
    assert all(r["whitened"] == 0 and r["explained"] == 0 for r in got if r["component"] == 3)
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1e12, 3.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(huge).collect()} == {None}
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], "vec_id long, embedding array<float>")).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, 0.0, 0.0, 1.0), (2, 1, 0, 0.0, 0.0, 1.0)]
    for none in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(none, "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("d", [1, 2, 5, 8, 33])
def test_op12_jacobi(d):
    rng = np.random.default_rng(d)
    basis = np.linalg.qr(rng.normal(size=(d, d)))[0]
    want = np.sort(10.0 ** rng.uniform(-3, 3, d))[::-1]
    values, vectors = whitening.jacobi((basis * want) @ basis.T)
    assert np.allclose(values, want, rtol=1e-9) and np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12)
    # small eigenvalues of a matrix that scales its dimensions very differently, to their own precision
    scale = 10.0 ** np.arange(0, -8 * d, -8)[:12]
    k = len(scale)
    near = np.eye(k) + 0.1 * np.ones((k, k))
    small = whitening.jacobi(near * np.outer(scale, scale))[0]
    exact = [float(np.linalg.det(near[: i + 1, : i + 1]) / (np.linalg.det(near[:i, :i]) if i else 1)) * scale[i] ** 2 for i in range(k)]
    assert np.allclose(small, exact, rtol=1e-9)
    pairs = [(int(p), int(q)) for a, b in whitening._rounds(d) for p, q in zip(a, b, strict=True)]
    assert sorted(pairs) == [(p, q) for p in range(d) for q in range(p + 1, d)]

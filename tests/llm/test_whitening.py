"""Whitening against plain numpy and exact fractions."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborline.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def _plain(rows, components=16):
    """n, S, deviation by x, covariance, by exact fractions; eigenvectors by numpy."""
    kept = [(k, v) for k, v, *_ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    xs = {k: tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v) for k, v in kept}
    fit = sorted(set(xs.values()))
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    cov = [[sum((x[i] - Fraction(s[i], n)) * (x[j] - Fraction(s[j], n)) for x in fit) / n for j in range(d)] for i in range(d)]
    return xs, n, s, np.array([[float(c) for c in row] for row in cov])


def test_against_exact_fractions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=5) * (1, 3, 0.5, 2, 1)], 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], 1) for i in range(30)]  # copies count once in the fit
    rows += [(200, None, 0), (201, [], 0), (202, [1.0, None, 0.0, 0.0, 0.0], 0), (203, [float("nan")] * 5, 0),
             (204, [float("inf")] * 5, 0), (205, [1.0, 2.0], 0), (None, rows[3][1], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("clash")).withColumn("key", F.lit(1)).repartition(5)
    out = whitening.whiten(df).collect()
    xs, n, s, cov = _plain([r for r in rows if r[0] is not None and r[0] != 205])
    assert {r["vec_id"] for r in out} == set(xs) | {None}
    assert len(out) == 5 * (len(xs) + 1)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = {}
    for r in out:
        x = xs[3 if r["vec_id"] is None else r["vec_id"]]
        c = r["component"] - 1
        assert r["n"] == n
        assert r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s))
        want = (np.array([float(a - Fraction(b, n)) for a, b in zip(x, s)]) @ vectors[:, c]) / np.sqrt(values[c])
        sign = signs.setdefault(c, np.sign(want * r["whitened"]))
        assert r["whitened"] * sign == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_few_or_equal_vectors_give_no_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(9)], SCHEMA)).count() == 0


def test_more_dimensions_than_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=30)], 0) for i in range(7)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in out} == set(range(1, 7))  # centred: one direction less than vectors
    assert out[0]["identity_error"] < 1e-9


def test_very_large_entries_stay_exact(spark):
    rows = [(0, [1e13, 0.0], 0), (1, [-1e13, 1.0], 0), (2, [0.5, 2.0], 0), (3, [1e30, 0.0], 0)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"] for r in out} == {0, 1, 2}
    assert [r["deviation"] for r in out if r["vec_id"] == 0] == [None]  # the other direction is below rounding


@pytest.mark.parametrize("values", [
    [5.0, 4.0, 3.0, 2.0, 1.0],
    [5.0, 5.0, 5.0, 2.0, 1.0],
    [5.0, 5.0 - 1e-9, 5.0 - 2e-9, 2.0, 2.0 - 1e-7],
    [1.0, 1e-3, 1e-6, 1e-9, 1e-10],
])
def test_refined_vectors(values):
    rng = np.random.default_rng(7)
    d = 40
    values = np.concatenate([values, np.linspace(0.5, 0.1, d - len(values)) * min(values)])
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    q = q.astype(np.longdouble)
    for _ in range(3):  # orthogonal to extended precision
        q = q @ (1.5 * np.eye(d) - 0.5 * q.T @ q)
    a = (q * values) @ q.T
    w, x = whitening.eigen(a)
    assert np.abs(w - np.sort(values)[::-1]).max() <= 1e-15 * max(values)
    assert np.abs(x.T @ x - np.eye(d)).max() < 2e-15
    assert np.abs((a @ x - x * w)).max() < 4e-16 * max(values) * 4
    for i, v in enumerate(values):  # alone in its place: the very vector
        if sum(abs(v - u) < 1e-3 * max(values) for u in values) == 1:
            assert abs(abs(q[:, i] @ x[:, list(np.argsort(-values)).index(i)]) - 1) < 1e-14
    # Apart by 1e-9: still told apart, far beyond float32.
    if values[0] - values[1] == pytest.approx(1e-9):
        assert abs(abs(q[:, 0] @ x[:, 0]) - 1) < 1e-6

"""Least squares by a tree of QR factors against exact rational arithmetic."""

from fractions import Fraction

import numpy as np
import pytest

from fathom.operators.models import fit_many, fit_qr


def exact(rows):
    """Coefficients of the last column on a constant and the others, solved in fractions."""
    a = [[Fraction(1), *map(Fraction, r[:-1])] for r in rows]
    y = [Fraction(r[-1]) for r in rows]
    k = len(a[0])
    m = [[sum(r[i] * r[j] for r in a) for j in range(k)] + [sum(r[i] * v for r, v in zip(a, y))] for i in range(k)]
    for i in range(k):
        p = next(j for j in range(i, k) if m[j][i])
        m[i], m[p] = m[p], m[i]
        m[i] = [v / m[i][i] for v in m[i]]
        for j in range(k):
            if j != i:
                m[j] = [v - m[j][i] * w for v, w in zip(m[j], m[i])]
    return [float(r[-1]) for r in m]


def frame(spark, rows, names):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{n} double" for n in names)).repartition(5)


def test_nearly_collinear_predictors_keep_their_digits(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(50, 1, 400)
    b = a + 1.4e-5 * rng.normal(0, 1, 400)                    # correlation about 1 - 1e-10
    y = 3 + 2 * a - b + rng.normal(0, 1e-6, 400)
    assert 1 - np.corrcoef(a, b)[0, 1] < 2e-10
    rows = list(zip(a.tolist(), b.tolist(), y.tolist()))
    got = fit_qr(frame(spark, rows, "aby"), [("y", ["a", "b"])]).first()
    assert [got.intercept, *got.coefs] == pytest.approx(exact(rows), rel=1e-8)
    assert got.n == 400 and got.r2 == pytest.approx(1.0, abs=1e-9)


def test_rank_drops_give_nulls(spark):
    rng = np.random.default_rng(2)
    a, y = rng.normal(0, 1, 50), rng.normal(0, 1, 50)
    cols = {"a": a, "twice": 2 * a, "shifted": 0.1 * a + 3, "flat": np.full(50, 7.7), "y": y, "still": np.full(50, 2.0)}
    df = frame(spark, zip(*cols.values()), list(cols))
    got = {r.predictors + ">" + r.response: r for r in fit_qr(df, [
        ("y", ["a", "twice"]), ("y", ["a", "shifted"]), ("y", ["flat"]), ("y", ["a"]), ("still", ["a"])]).collect()}
    for k in ("a+twice>y", "a+shifted>y", "flat>y"):
        assert got[k].intercept is None and set(got[k].coefs) == {None} and got[k].r2 is None, k
    assert got["a>y"].coefs[0] == pytest.approx(exact(list(zip(a.tolist(), y.tolist())))[1])
    assert got["a>still"].r2 is None and got["a>still"].coefs[0] == pytest.approx(0, abs=1e-12)


def test_many_predictors_nulls_and_the_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 4))
    y = x @ [1, -2, 0.5, 3] + 4 + rng.normal(0, 0.1, 300)
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0, 1.0), (1.0, float("nan"), 1.0, 1.0, 1.0)],
                               "a double, b double, c double, d double, y double").repartition(7)
    four = fit_qr(df, [("y", list("abcd"))]).first()
    assert [four.intercept, *four.coefs] == pytest.approx(exact(rows)) and four.n == 300
    two = {r.predictors: r for r in fit_qr(df, [("y", ["a"]), ("y", ["c", "d"])]).collect()}
    for r in fit_many(df, [("y", ["a"]), ("y", ["c", "d"])]).collect():
        q = two[r.predictors]
        assert [q.intercept, *q.coefs, q.r2, q.n] == pytest.approx([v for v in (r.intercept, r.coef1, r.coef2, r.r2, r.n) if v is not None])
    none = fit_qr(df.limit(0), [("y", ["a"])]).collect()
    assert [(r.n, r.intercept) for r in none] in ([], [(0, None)])

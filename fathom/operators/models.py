"""Least-squares fits as distributed aggregates.

A fit is a handful of sums over the table (map-side partial aggregation), solved in
closed form in column expressions: nothing but one row per model reaches the end.
Rows with a null or NaN in any variable of a model are dropped for that model only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _complete(cols: Sequence[str]) -> Column:
    c = F.lit(True)
    for name in cols:
        c = c & F.col(name).isNotNull() & ~F.isnan(F.col(name))
    return c


def _moment_aggs(tag: str, y: str, xs: Sequence[str]) -> list[Column]:
    ok = _complete([y, *xs])
    m = {v: F.when(ok, F.col(v).cast("double")) for v in [y, *xs]}
    out = [F.count(F.when(ok, F.lit(1))).alias(f"{tag}__n"),
           F.avg(m[y]).alias(f"{tag}__my"), F.var_pop(m[y]).alias(f"{tag}__vy")]
    for i, x in enumerate(xs):
        out += [F.avg(m[x]).alias(f"{tag}__m{i}"), F.var_pop(m[x]).alias(f"{tag}__v{i}"),
                F.covar_pop(m[x], m[y]).alias(f"{tag}__c{i}y")]
    if len(xs) == 2:
        out.append(F.covar_pop(m[xs[0]], m[xs[1]]).alias(f"{tag}__c01"))
    return out


def _solve(tag: str, y: str, xs: Sequence[str]) -> Column:
    c = lambda s: F.col(f"{tag}__{s}")
    div = F.try_divide   # a constant predictor or response gives NULL, not an error
    if len(xs) == 1:
        b1 = div(c("c0y"), c("v0"))
        b2 = F.lit(None).cast("double")
        r2 = div(c("c0y") * c("c0y"), c("v0") * c("vy"))
        b0 = c("my") - b1 * c("m0")
    elif len(xs) == 2:
        det = c("v0") * c("v1") - c("c01") * c("c01")
        b1 = div(c("c0y") * c("v1") - c("c1y") * c("c01"), det)
        b2 = div(c("c1y") * c("v0") - c("c0y") * c("c01"), det)
        r2 = div(b1 * c("c0y") + b2 * c("c1y"), c("vy"))
        b0 = c("my") - b1 * c("m0") - b2 * c("m1")
    else:
        raise ValueError("closed form covers one or two predictors; use fit_normal_equations")
    return F.struct(F.lit(y).alias("response"), F.lit("+".join(xs)).alias("predictors"),
                    b0.alias("intercept"), b1.alias("coef1"), b2.alias("coef2"),
                    r2.alias("r2"), c("n").alias("n"))


def fit_many(df: DataFrame, models: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Fit every (response, predictors) model in ONE aggregate pass.

    Returns one row per model: response, predictors ('a+b'), intercept, coef1, coef2,
    r2, n."""
    aggs, fits = [], []
    for k, (y, xs) in enumerate(models):
        aggs += _moment_aggs(f"m{k}", y, xs)
        fits.append(_solve(f"m{k}", y, xs))
    moments = df.agg(*aggs)
    return moments.select(F.explode(F.array(*fits)).alias("__f")).select("__f.*")


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """One model (one row)."""
    return fit_many(df, [(y, xs)])


def ols_builtin(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """R1 with Spark's regression aggregates (null pairs skipped by the aggregate)."""
    aggs = []
    for y, x in pairs:
        aggs.append(F.struct(F.lit(y).alias("response"), F.lit(x).alias("predictor"),
                             F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"),
                             F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n")))
    return df.agg(F.array(*aggs).alias("__a")).select(F.explode("__a").alias("__f")).select("__f.*")


def predict_line(fit: DataFrame, xs: DataFrame, x: str) -> DataFrame:
    """Intercept + coef1 * x over a range of x, for every row of ``fit``."""
    return xs.crossJoin(fit.select("response", "intercept", "coef1")).select(
        "response", x, (F.col("intercept") + F.col("coef1") * F.col(x)).alias("fitted"))


def fit_normal_equations(df: DataFrame, y: str, xs: Sequence[str]):
    """R2 beyond two predictors: Spark ML's normal-equation solver (distributed Gram matrix)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    data = VectorAssembler(inputCols=list(xs), outputCol="__features").transform(
        df.filter(_complete([y, *xs])))
    return LinearRegression(featuresCol="__features", labelCol=y, solver="normal").fit(data)


#: A predictor is taken as a combination of the ones before it if what is left of it is less than this
#: part of its spread, and as constant if its spread is less than this part of its mean.
RANK_TOLERANCE = 1e-12
_MERGE = 64


def _stack(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The R factor of ``r`` on top of ``rows``, square."""
    k = r.shape[1]
    out = np.linalg.qr(np.vstack([r, rows]), mode="r")
    return np.vstack([out, np.zeros((k - len(out), k))]) if len(out) < k else out


def _from_factor(r: np.ndarray, n: int) -> tuple[float | None, list[float | None], float | None]:
    """(intercept, coefficients, r2) from the R factor of [1, predictors, response]; None where the rank drops."""
    p = len(r) - 2
    spread = [float(np.linalg.norm(r[1:, j])) for j in range(p + 2)]
    flat = [spread[j] <= RANK_TOLERANCE * abs(r[0, j]) or abs(r[j, j]) <= RANK_TOLERANCE * spread[j] for j in range(1, p + 1)]
    if n <= p or any(flat):
        return None, [None] * p, None
    beta = np.zeros(p + 1)
    for j in range(p, -1, -1):
        beta[j] = (r[j, p + 1] - r[j, j + 1:p + 1] @ beta[j + 1:]) / r[j, j]
    same = spread[p + 1] <= RANK_TOLERANCE * abs(r[0, p + 1])
    return float(beta[0]), [float(b) for b in beta[1:]], None if same else 1 - float(r[p + 1, p + 1] / spread[p + 1]) ** 2


def fit_qr(df: DataFrame, models: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """R1-R3, R5 for any number of predictors in one pass, by a QR factorisation over a tree of tasks.

    Returns one row a model: response, predictors ('a+b'), intercept, coefs, r2, n. Every task turns
    its rows [1, predictors, response] into their R factor, batch by batch; factors are stacked and
    factored again, first 64 ways, then to one. Unlike the normal equations this does not square the
    condition of the predictors, so that nearly collinear ones keep their digits. Constant or collinear
    predictors, and fewer rows than coefficients, give NULL coefficients and r2; a response without
    spread has a NULL r2. Rows with a null or NaN in a model's variables are left out of that model."""
    models = [(y, list(xs)) for y, xs in models]
    names = sorted({c for y, xs in models for c in (y, *xs)})
    place = {c: i for i, c in enumerate(names)}
    widths = [len(xs) + 2 for _, xs in models]

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        rs, ns = [np.zeros((w, w)) for w in widths], [0] * len(models)
        for b in batches:
            cols = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns])
            for m, (y, xs) in enumerate(models):
                a = cols[:, [place[c] for c in (*xs, y)]]
                a = a[~np.isnan(a).any(axis=1)]
                rs[m], ns[m] = _stack(rs[m], np.column_stack([np.ones(len(a)), a])), ns[m] + len(a)
        yield pa.RecordBatch.from_pydict({"model": list(range(len(models))), "part": [TaskContext.get().partitionId() % _MERGE] * len(models),
                                          "n": ns, "r": [r.ravel().tolist() for r in rs]})

    def merged(pdf: pd.DataFrame) -> tuple[int, int, np.ndarray]:
        m = int(pdf["model"].iloc[0])
        r = np.zeros((widths[m], widths[m]))
        for one in pdf["r"]:
            r = _stack(r, np.asarray(one).reshape(r.shape))
        return m, int(pdf["n"].sum()), r

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        m, n, r = merged(pdf)
        return pd.DataFrame({"model": [m], "part": [0], "n": [n], "r": [r.ravel().tolist()]})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m, n, r = merged(pdf)
        b0, coefs, r2 = _from_factor(r, n)
        return pd.DataFrame({"response": [models[m][0]], "predictors": ["+".join(models[m][1])], "intercept": pd.array([b0], "Float64"),
                             "coefs": [coefs], "r2": pd.array([r2], "Float64"), "n": [n]})

    kind = "model long, part long, n long, r array<double>"
    parts = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(factor, kind)
    parts = parts.groupBy("model", "part").applyInPandas(merge, kind)
    return parts.groupBy("model").applyInPandas(
        solve, "response string, predictors string, intercept double, coefs array<double>, r2 double, n long")

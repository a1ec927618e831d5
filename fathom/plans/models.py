"""Regressions of migration metrics on segment backscatter and ocean records (Q2/Q3 fits)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import models as MO
from fathom.plans.catalog import query
from fathom.plans.grids import _OCEAN, _SUMMARY, _WS_SUMMARY, grid_sql, migration_table, ocean_daily

RESPONSES = ["delta_cm", "delta_layertop", "cm_noon", "layertop_noon"]
SINGLE = ["nschools", "sa_db"]
PAIR = ["sa_db", "nschools"]


def _complete_sql(cols):
    return " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in cols)


def _fit_sql(y: str, xs: list[str]) -> str:
    ok = _complete_sql([y, *xs])
    f = f"FILTER (WHERE {ok})"
    if len(xs) == 1:
        x = xs[0]
        b1 = f"covar_pop({x}, {y}) {f} / NULLIF(var_pop({x}) {f}, 0)"
        return (f"SELECT '{y}' AS response, '{x}' AS predictors, "
                f"avg({y}) {f} - ({b1}) * avg({x}) {f} AS intercept, {b1} AS coef1, "
                f"CAST(NULL AS DOUBLE) AS coef2, "
                f"covar_pop({x}, {y}) {f} * covar_pop({x}, {y}) {f} / NULLIF(var_pop({x}) {f} * var_pop({y}) {f}, 0) AS r2, "
                f"count(*) {f} AS n FROM migration")
    a, b = xs
    v0, v1 = f"var_pop({a}) {f}", f"var_pop({b}) {f}"
    c01, c0y, c1y = f"covar_pop({a}, {b}) {f}", f"covar_pop({a}, {y}) {f}", f"covar_pop({b}, {y}) {f}"
    det = f"NULLIF({v0} * {v1} - {c01} * {c01}, 0)"
    b1 = f"(({c0y} * {v1} - {c1y} * {c01}) / {det})"
    b2 = f"(({c1y} * {v0} - {c0y} * {c01}) / {det})"
    return (f"SELECT '{y}' AS response, '{a}+{b}' AS predictors, "
            f"avg({y}) {f} - {b1} * avg({a}) {f} - {b2} * avg({b}) {f} AS intercept, {b1} AS coef1, {b2} AS coef2, "
            f"({b1} * {c0y} + {b2} * {c1y}) / NULLIF(var_pop({y}) {f}, 0) AS r2, count(*) {f} AS n FROM migration")


def _models(single=True, pair=True):
    out = []
    for y in RESPONSES:
        if single:
            out += [(y, [x]) for x in SINGLE]
        if pair:
            out.append((y, PAIR))
    return out


@query("ols_simple", ops="R1 R3", sql=grid_sql(" UNION ALL ".join(
    f"SELECT '{y}' AS response, '{x}' AS predictor, "
    f"CASE WHEN regr_sxx({y}, {x}) = 0 THEN NULL ELSE regr_intercept({y}, {x}) END AS intercept, "
    f"CASE WHEN regr_sxx({y}, {x}) = 0 THEN NULL ELSE regr_slope({y}, {x}) END AS slope, "
    f"CASE WHEN regr_sxx({y}, {x}) = 0 THEN NULL "
    f"WHEN regr_syy({y}, {x}) = 0 THEN 1.0 ELSE regr_r2({y}, {x}) END AS r2, "
    f"CAST(regr_count({y}, {x}) AS BIGINT) AS n "
    f"FROM migration" for y in RESPONSES for x in SINGLE), _SUMMARY))
def q_ols_simple(spark, sf):
    return MO.ols_builtin(migration_table(spark, sf), [(y, x) for y in RESPONSES for x in SINGLE])


@query("ols_two", ops="R2 R3", sql=grid_sql(" UNION ALL ".join(
    _fit_sql(y, xs) for y, xs in _models(single=False)), _SUMMARY))
def q_ols_two(spark, sf):
    return MO.fit_many(migration_table(spark, sf), _models(single=False))


@query("ols_many", ops="R5 R1 R2 R3", sql=grid_sql(" UNION ALL ".join(
    _fit_sql(y, xs) for y, xs in _models()), _SUMMARY))
def q_ols_many(spark, sf):
    return MO.fit_many(migration_table(spark, sf), _models())


@query("watershed_ols", ops="R5 R1 R2 R3", sql=grid_sql(" UNION ALL ".join(
    _fit_sql(y, xs) for y, xs in _models()), _WS_SUMMARY))
def q_watershed_ols(spark, sf):
    """The fits on the reference's own segments."""
    return MO.fit_many(migration_table(spark, sf, use_watershed=True), _models())


@query("ols_qr", ops="R2 R5 R3", sql=grid_sql(" UNION ALL ".join(
    _fit_sql(y, xs) for y, xs in _models()), _SUMMARY))
def q_ols_qr(spark, sf):
    """The same fits by a QR factorisation over a tree of tasks."""
    fits = MO.fit_qr(migration_table(spark, sf), _models())
    return fits.select("response", "predictors", "intercept", F.get("coefs", F.lit(0)).alias("coef1"),
                       F.get("coefs", F.lit(1)).alias("coef2"), "r2", "n")


@query("ols_predict", ops="R4 S8", sql=grid_sql(f"""
    SELECT f.response, CAST(x AS DOUBLE) AS sa_db, f.intercept + f.coef1 * x AS fitted
    FROM ({_fit_sql('delta_layertop', ['sa_db'])} UNION ALL {_fit_sql('layertop_noon', ['sa_db'])}) f
    CROSS JOIN (SELECT unnest(range(CAST(floor(min(sa_db)) AS BIGINT), CAST(ceil(max(sa_db)) AS BIGINT) + 1)) AS x
                FROM migration)""", _SUMMARY))
def q_ols_predict(spark, sf):
    mig = migration_table(spark, sf)
    fits = MO.fit_many(mig, [("delta_layertop", ["sa_db"]), ("layertop_noon", ["sa_db"])])
    rng = mig.agg(F.floor(F.min("sa_db")).cast("long").alias("__lo"),
                  F.ceil(F.max("sa_db")).cast("long").alias("__hi"))
    xs = rng.select(F.explode(F.sequence("__lo", "__hi")).alias("__x")).select(
        F.col("__x").cast("double").alias("sa_db"))
    return MO.predict_line(fits, xs, "sa_db")


_OCEAN_SQL = " UNION ALL ".join([
    _fit_sql("layertop_noon", ["temperature"]).replace("FROM migration", "FROM ocean"),
    _fit_sql("layertop_noon", ["sealevel"]).replace("FROM migration", "FROM ocean"),
    _fit_sql("layertop_noon", ["upwelling"]).replace("FROM migration", "FROM ocean_complete"),
])


@query("ocean_models", ops="Q3 R1 P11", sql=grid_sql(
    _OCEAN_SQL, _OCEAN + """,
  ocean_complete AS (SELECT * FROM ocean WHERE """ + " AND ".join(
        f"{c} IS NOT NULL" for c in ["temperature", "upwelling", "sealevel", "date", "cm_noon", "cm_midnight",
                                     "layertop_noon", "layertop_midnight", "delta_cm", "delta_layertop",
                                     "nschools", "sa", "mean_depth", "max_depth", "sa_db"]) + ")",
    views=("v_grid", "v_env")))
def q_ocean_models(spark, sf):
    ocean = ocean_daily(spark, sf).join(migration_table(spark, sf), "date", "right")
    a = MO.fit_many(ocean, [("layertop_noon", ["temperature"]), ("layertop_noon", ["sealevel"])])
    # the upwelling fit first drops rows with a null in ANY column (Julia ``dropmissing``)
    complete = ocean.filter(F.greatest(*[F.col(c).isNull().cast("int") for c in ocean.columns]) == 0)
    b = MO.fit_many(complete, [("layertop_noon", ["upwelling"])])
    return a.unionByName(b)

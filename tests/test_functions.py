"""Golden micro-fixtures worked out by hand (FIXTURES.md §3)."""

import math

import pytest
from pyspark.sql import functions as F

from fathom.functions import math as M
from fathom.operators import aggregates as A
from fathom.operators import models as MO
from fathom.operators import sequence as S


def col(df, name):
    return [r[name] for r in df.collect()]


def series(spark, values, name="x"):
    return spark.createDataFrame([(i + 1, None if v is None else float(v)) for i, v in enumerate(values)],
                                 f"t long, {name} double")


def test_round_half_even(spark):
    df = spark.createDataFrame([(250.0,), (150.0,), (25.0,)], "x double")
    out = df.select(M.round_even("x", -2).alias("h"), M.round_even("x", -1).alias("t")).collect()
    assert [out[0]["h"], out[1]["h"], out[2]["t"]] == [200.0, 200.0, 20.0]


def test_db_of_zero(spark):
    r = spark.createDataFrame([(0.0,)], "x double").select(
        M.to_db("x").alias("d"), M.neg_inf_to_null(M.to_db("x")).alias("n")).first()
    assert r["d"] == float("-inf") and r["n"] is None


def test_strict_vs_skip_mean(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    r = df.agg(A.mean_strict("x").alias("s"), A.mean_skip("x").alias("k")).first()
    assert r["s"] is None and r["k"] == 1.0


def test_diff0(spark):
    df = S.with_row_index(series(spark, [3.0, 5.0, None, 6.0]), ["t"], "rn")
    out = S.diff0(df, "rn", ["x"], block_rows=2).orderBy("t")
    assert col(out, "dx") == [0.0, 2.0, None, None]


def test_moving_mean_replicate(spark):
    df = S.with_row_index(series(spark, [0, 1, 2, 3, 4, 5]), ["t"], "rn")
    out = S.moving_mean(df, "rn", ["x"], 5, block_rows=3).orderBy("t")
    assert col(out, "x_smooth") == pytest.approx([0.6, 1.2, 2.0, 3.0, 3.8, 4.4])


def test_quantile_type7(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    r = A.exact_quantiles(df, "x", {"q": 0.95}).first()
    assert r["q"] == pytest.approx(8.55)


def test_run_labels(spark):
    df = spark.createDataFrame([(i + 1, b) for i, b in enumerate([False, True, True, False, True])],
                               "t long, f boolean")
    idx = S.with_row_index(df, ["t"], "rn")
    out = S.label_runs(idx, "rn", "f", "lab", block_rows=2).orderBy("t")
    assert col(out, "lab") == [0, 1, 1, 0, 2]


@pytest.mark.parametrize("hot,expected", [(6, list(range(5, 11))), (3, list(range(3, 8)))])
def test_dilation(spark, hot, expected):
    df = spark.createDataFrame([(i, i == hot) for i in range(1, 11)], "t long, f boolean")
    idx = S.with_row_index(df, ["t"], "rn")
    out = S.dilate(idx, "rn", "f", "d", back=4, ahead=1, block_rows=3).orderBy("t")
    assert [t for t, d in zip(col(out, "t"), col(out, "d")) if d] == expected


def test_layer_crossing_and_centre_of_mass(spark):
    from fathom.operators.grid import layer_metrics
    rows = [("a", 1, 1, 10.0, 4e-7), ("a", 1, 2, 20.0, 9e-7), ("a", 1, 3, 30.0, 2e-7)]
    g = spark.createDataFrame(rows, "g string, xi int, yi int, depth double, sv double") \
        .withColumn("Sv", 10 * F.log10("sv")).withColumn("label", F.lit(0)).withColumn("ts", F.lit(1))
    kept = spark.createDataFrame([], "g string, label int")
    r = layer_metrics(g, kept, ["g"], "ts", "depth", "Sv").first()
    assert r["layertop"] == 20.0 and r["layerbase"] == 20.0
    w = spark.createDataFrame([(10.0, 1.0), (20.0, 3.0)], "d double, w double")
    assert w.agg(A.weighted_mean("d", "w").alias("cm")).first()["cm"] == pytest.approx(17.5)


def test_path_length(spark):
    from fathom.plans.series import bout_table
    rows = [(1, "2024-01-01 00:00:00", 1, 0.0), (1, "2024-01-01 01:00:00", 1, 2.0),
            (1, "2024-01-01 02:00:00", 1, -1.0), (2, "2024-01-02 00:00:00", 1, 5.0)]
    df = spark.createDataFrame(rows, "bout_label long, ts string, n long, rel_depth double") \
        .withColumn("datetime_round", F.col("ts").cast("timestamp_ntz")).drop("ts")
    out = {r["bout_label"]: r for r in bout_table(df).collect()}
    assert out[1]["distance"] == 5.0 and out[2]["distance"] == 0.0
    assert out[1]["init_dive_speed"] == pytest.approx(0.1) and out[2]["init_dive_speed"] is None


def test_components_corner(spark):
    from fathom.operators.components import connected_components
    cells = spark.createDataFrame([("a", 1, 1, 2), ("a", 2, 2, 2)], "g string, xi int, yi int, nx int")
    out = connected_components(cells, ["g"]).collect()
    assert len({r["comp"] for r in out}) == 2


def test_densify(spark):
    from fathom.operators.grid import densify
    obs = spark.createDataFrame([("a", 1, 10.0, -50.0), ("a", 1, 20.0, -95.0), ("a", 2, 10.0, -70.0)],
                                "g string, x int, y double, v double")
    out = densify(obs, ["g"], "x", "y", "v").collect()
    assert len(out) == 4
    vals = {(r["x"], r["y"]): r["v"] for r in out}
    assert vals[(2, 20.0)] == -90.0 and vals[(1, 20.0)] == -90.0 and vals[(1, 10.0)] == -50.0


def test_pivot_duplicate_raises(spark):
    df = spark.createDataFrame([("d", "noon", 1.0), ("d", "noon", 2.0)], "d string, k string, v double")
    with pytest.raises(Exception):
        A.pivot_wide(df, ["d"], "k", "v", ["noon"]).collect()


def test_ols_one_predictor(spark):
    df = spark.createDataFrame([(2.0, 1.0), (3.0, 2.0), (5.0, 3.0)], "x double, y double")
    r = MO.ols(df, "y", ["x"]).first()
    assert r["coef1"] == pytest.approx(0.642857, abs=1e-6)
    assert r["intercept"] == pytest.approx(-0.142857, abs=1e-6)
    assert r["r2"] == pytest.approx(0.964286, abs=1e-6)
    b = MO.ols_builtin(df, [("y", "x")]).first()
    assert b["slope"] == pytest.approx(r["coef1"]) and b["r2"] == pytest.approx(r["r2"])


def test_ols_two_predictors_match_normal_equations(spark):
    rows = [(float(i), float((i * 7) % 5), 1.5 * i - 0.5 * ((i * 7) % 5) + (i % 3) * 0.1) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    r = MO.ols(df, "y", ["a", "b"]).first()
    m = MO.fit_normal_equations(df, "y", ["a", "b"])
    assert r["coef1"] == pytest.approx(m.coefficients[0]) and r["coef2"] == pytest.approx(m.coefficients[1])
    assert r["intercept"] == pytest.approx(m.intercept) and r["r2"] == pytest.approx(m.summary.r2)


def test_squish_and_clamp(spark):
    df = spark.createDataFrame([(-100.0,), (-70.0,), (None,), (float("-inf"),)], "x double")
    out = df.select(M.squish("x", -90, -60).alias("s"), M.floor_clamp("x", -90, True).alias("j"),
                    M.floor_clamp("x", -90, False).alias("r")).collect()
    assert [r["s"] for r in out] == [-90.0, -70.0, None, float("-inf")]
    assert [r["j"] for r in out] == [-90.0, -70.0, -90.0, -90.0]
    assert [r["r"] for r in out][:3] == [-90.0, -70.0, None]
    assert math.isinf(out[3]["s"])


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_clock_readings_do_not_pass_through_the_session_zone(spark, zone):
    from fathom.functions import time as T
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("2019-11-05T04:00:05",), ("2019/03/10 02:30:00",), ("2019-03-10 02:30:00.5",), ("junk",), (None,)], "s string")
        got = [r[0] for r in df.select(T.parse_ts("s", T.PATTERNS["ymd_hms"]).cast("string")).collect()]
        assert got == ["2019-11-05 04:00:05", "2019-03-10 02:30:00", "2019-03-10 02:30:00.5", None, None]
        one = spark.sql("SELECT TIMESTAMP_NTZ'2019-03-07 01:00:00' AS ts").select(
            T.zone_instant("ts", "America/Los_Angeles").cast("string")).first()[0]
        assert one == "2019-03-07 09:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_scalar_must_be_one_row(spark):
    from fathom.operators.relational import with_scalar
    df, two = spark.range(3), spark.createDataFrame([(1,), (2,)], "s int")
    assert [r.s for r in with_scalar(df, two.limit(1)).collect()] == [1, 1, 1]
    assert with_scalar(df, two.limit(0)).count() == 0
    with pytest.raises(Exception, match="more than one row"):
        with_scalar(df, two).collect()

"""J8 through the index of intervals, against comparing every row with every interval."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fathom.operators.relational import interval_join


def both(rows, bounds):
    few = interval_join(rows, bounds, "lo", "hi", "s", "e", few=10 ** 9)
    many = interval_join(rows, bounds, "lo", "hi", "s", "e", few=0)
    key = [*rows.columns, *bounds.columns]
    return [sorted(map(str, d.select(key).collect())) for d in (few, many)]


def test_lengths_of_all_sizes_reversed_rows_and_edges(spark):
    rnd = random.Random(5)
    inf = float("inf")
    rows = []
    for i in range(400):
        lo = rnd.choice([rnd.uniform(-50, 50), float(rnd.randint(-4, 4)), 2.0 ** rnd.randint(-5, 20)])
        rows.append((i, lo, rnd.choice([lo, lo + rnd.random(), lo - rnd.choice([0.1, 3.0, 70.0, 1e6])])))
    rows += [(900, None, 1.0), (901, 1.0, None), (902, inf, 3.0), (903, -inf, 3.0), (904, 0.0, -inf)]
    bounds = []
    for i in range(150):
        s = rnd.choice([rnd.uniform(-60, 60), float(rnd.randint(-4, 4))])
        bounds.append((i, s, s + rnd.choice([0.0, -1.0, 0.01, 0.5, 1.0, 2.0, 64.0, 1e5, 1e300])))
    bounds += [(900, None, 1.0), (901, 0.0, None), (902, -inf, inf), (903, -inf, 0.0), (904, 5.0, inf)]
    few, many = both(spark.createDataFrame(rows, "r long, lo double, hi double"), spark.createDataFrame(bounds, "b long, s double, e double"))
    real = [r for r in few if "s=" in r]
    assert many == real and len(many) > 5000


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "long"])
def test_axes(spark, kind):
    rnd = random.Random(6)
    day = dt.datetime(2019, 11, 1)

    def at():
        return day + dt.timedelta(seconds=rnd.randint(0, 90) * 86_400 + rnd.choice([0, 0, 3_600, 59]))

    def typed(df, cols):
        for c in cols:
            df = df.withColumn(c, F.unix_micros(F.col(c).cast("timestamp")) if kind == "long" else F.col(c).cast(kind))
        return df

    rows = typed(spark.createDataFrame([(i, x, x) for i, x in ((i, at()) for i in range(200))], "r long, lo timestamp_ntz, hi timestamp_ntz"), ["lo", "hi"])
    bounds = typed(spark.createDataFrame([(i, x, x + dt.timedelta(hours=rnd.choice([1, 24, 30, 999]))) for i, x in ((i, at()) for i in range(100))],
                                         "b long, s timestamp_ntz, e timestamp_ntz"), ["s", "e"])
    few, many = both(rows, bounds)
    assert few == many and few


def test_plans(spark):
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_orderkey", F.col("l_shipdate").alias("lo"), F.col("l_shipdate").alias("hi"))
    start = F.timestamp_add("HOUR", (F.col("id") * 7919 % 60_000).cast("int"), F.lit("1992-01-01").cast("timestamp_ntz"))
    bounds = spark.range(100_000).select("id", start.alias("s"), F.timestamp_add("DAY", (F.col("id") % 40 + 1).cast("int"), start).alias("e"))
    out = interval_join(li, bounds, "lo", "hi", "s", "e")
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    few = interval_join(li, bounds.filter("id < 5"), "lo", "hi", "s", "e")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin BuildRight" in plan
    n = interval_join(li, bounds.filter("id < 2000"), "lo", "hi", "s", "e").count()
    assert n == interval_join(li, bounds.filter("id < 2000"), "lo", "hi", "s", "e", few=10 ** 9).count()


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date", "double"])
def test_totals_of_intervals(spark, kind):
    """Clustered and repeated times before and after 1970, intervals from empty to longer than all."""
    rnd = random.Random(9)
    def at():
        return rnd.choice([0, 0, 5, 10 ** 6, 86400 * 10 ** 6, rnd.randint(-50, 50), rnd.randint(-10 ** 9, 10 ** 9),
                           rnd.randint(-10 ** 15, 10 ** 15), 86400 * 10 ** 6 * rnd.randint(-900, 900)])
    def col(c):
        micros = F.timestamp_add("MICROSECOND", F.col(c), F.lit("1970-01-01").cast("timestamp_ntz"))
        return (F.col(c).cast("double") if kind == "double" else micros.cast(kind)).alias(c)
    rows = [(at(), rnd.choice([None, 1.0, 2.0, 7.0])) for _ in range(1500)] + [(None, 1.0)] * 3
    bounds = [(i % 250, s, s + rnd.choice([0, -1, 1, 2, 3, 60, 10 ** 6, 10 ** 10, 86400 * 10 ** 6 * 3, 10 ** 14, 10 ** 16])) for i, s in enumerate(at() for _ in range(300))]
    bounds += [(900, None, 5), (901, 5, None)]
    r = spark.createDataFrame(rows, "x long, q double").select(col("x"), "q")
    b = spark.createDataFrame(bounds, "id long, s long, e long").select("id", col("s"), col("e"))
    plain = interval_join(r, b, "x", "x", "s", "e", few=10 ** 9).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("first"), F.max("x").alias("last"), F.sum("q").alias("q"))
    parts = interval_join(r, b, "x", "x", "s", "e", totals={
        "n": (F.lit(1), "sum"), "first": (F.col("x"), "min"), "last": (F.col("x"), "max"), "q": (F.col("q"), "sum")})
    got = parts.groupBy("id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("q").alias("q"))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() > 50


def test_totals_do_not_grow_with_the_rows_of_an_interval(spark):
    start = F.lit("2020-01-01").cast("timestamp_ntz")
    rows = spark.range(20_000).select(F.timestamp_add("SECOND", F.col("id") * 37 % 10 ** 6, start).alias("x"))
    bounds = spark.range(100).select("id", F.timestamp_add("SECOND", F.col("id"), start).alias("s"), F.timestamp_add("SECOND", F.col("id") + 900_000, start).alias("e"))
    parts = interval_join(rows, bounds, "x", "x", "s", "e", totals={"n": (F.lit(1), "sum")})
    assert parts.count() < 100 * 200
    assert parts.agg(F.sum("n")).first()[0] == interval_join(rows, bounds, "x", "x", "s", "e").count() > 10 ** 6

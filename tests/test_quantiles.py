"""A6/A7 by radix select, against DuckDB and plain sorting."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fathom.operators import aggregates as A

PROBS = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q95": 0.95, "q100": 1.0}


def type7(vals, p):
    v = sorted(vals)
    h = (len(v) - 1) * p
    lo = math.floor(h)
    return v[lo] + (h - lo) * (v[min(lo + 1, len(v) - 1)] - v[lo])


def rows():
    rnd = random.Random(3)
    out = [("wide", rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300)) for _ in range(500)]
    out += [("ties", float(rnd.randint(-3, 3))) for _ in range(400)]
    out += [("close", 1.0 + rnd.randint(0, 50) * 2.0 ** -52) for _ in range(300)]
    out += [("powers", rnd.choice([-1, 1]) * 2.0 ** e) for e in range(-1074, 1024, 7)]
    out += [("tiny", rnd.choice([-1, 1]) * rnd.randint(0, 9) * 5e-324) for _ in range(50)]
    out += [("one", 7.25), ("nulls", None), ("nulls", float("nan")), ("some", None), ("some", 1.0), ("some", 4.0), (None, 2.0), (None, 3.0)]
    return out + [("inf", x) for x in (float("inf"), float("-inf"), 0.0, -0.0, 1e308, float("inf"))]


@pytest.mark.parametrize("nulls", ["skip", "propagate"])
def test_every_group_against_sorting(spark, nulls):
    data = rows()
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    got = {r.g: r for r in A.exact_quantiles(df, "v", PROBS, ["g"], nulls).collect()}
    assert set(got) == {g for g, _ in data}
    for g in got:
        own = [v for k, v in data if k == g]
        real = [v for v in own if v is not None and not math.isnan(v)]
        for name, p in PROBS.items():
            have = got[g][name]
            if not real or (nulls == "propagate" and len(real) < len(own)):
                assert have is None
            else:
                want = type7(real, p)
                assert have == want or (math.isnan(want) and math.isnan(have)) or have == pytest.approx(want, rel=1e-12), (g, name)


def test_keys_are_longs_in_the_order_of_the_numbers(spark):
    vals = sorted({v for _, v in rows() if v is not None and not math.isnan(v)})
    df = A._sortable(spark.createDataFrame([(v,) for v in vals], "v double"), "v", "key")
    keys = [r.key for r in df.orderBy("v").collect()]
    assert all(a < b for a, b in zip(keys, keys[1:]))


def test_equal_to_duckdb_and_without_a_sort_of_the_rows(spark):
    sf = "/root/testdata/sf0.001"
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    out = A.exact_quantiles(li, "l_extendedprice", {"a": 0.25, "b": 0.5, "c": 0.99}, ["l_returnflag", "l_linenumber"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    # one join of groups with their results; the rows meet the wanted ranks by a broadcast
    assert "Window" not in plan and "rangepartitioning" not in plan and plan.count("SortMergeJoin") <= 1 and "BroadcastHashJoin" in plan
    want = duckdb.sql(f"""SELECT l_returnflag, l_linenumber, quantile_cont(l_extendedprice, 0.25), quantile_cont(l_extendedprice, 0.5),
        quantile_cont(l_extendedprice, 0.99) FROM '{sf}/lineitem.parquet' GROUP BY ALL""").fetchall()
    got = {tuple(r)[:2]: tuple(r)[2:] for r in out.collect()}
    assert len(got) == len(want)
    for r in want:
        assert got[r[:2]] == pytest.approx(r[2:], rel=1e-14)


def test_many_groups_are_joined_with_a_shuffle(spark, monkeypatch):
    df = spark.createDataFrame(rows(), "g string, v double")
    want = sorted(map(str, A.exact_quantiles(df, "v", PROBS, ["g"]).collect()))
    monkeypatch.setattr(A, "SENT_RANKS", 0)
    assert sorted(map(str, A.exact_quantiles(df, "v", PROBS, ["g"]).collect())) == want


def test_no_groups_and_no_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert tuple(A.exact_quantiles(df, "v", {"m": 0.5, "q": 0.25}).first()) == (5.0, 2.5)
    assert tuple(A.exact_quantiles(df.filter(F.col("v") < 0), "v", {"m": 0.5}).first()) == (None,)
    assert A.exact_quantiles(df.filter(F.col("v") < 0).withColumn("g", F.lit(1)), "v", {"m": 0.5}, ["g"]).collect() == []

"""W10 properties: the distributed index/halo windows equal the naive single-partition
window, whatever the block size and partition count."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.operators import sequence as S


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 40), i, rnd.choice([None, rnd.random()])) for i in range(300)]
    return spark.createDataFrame(rows, "k long, tb long, x double")


@pytest.fixture
def ranges(spark):
    """Set the number of ranges, which AQE then leaves alone."""
    keys = {"spark.sql.shuffle.partitions": None, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}

    def put(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")

    yield put
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_row_index_matches_row_number(data, ranges, parts):
    naive = data.withColumn("rn0", F.row_number().over(Window.orderBy("k", "tb")))
    ranges(parts)
    idx = S.with_row_index(data, ["k", "tb"], "rn")
    bad = idx.join(naive, ["k", "tb"]).filter(F.col("rn") != F.col("rn0")).count()
    assert bad == 0 and idx.count() == 300


def test_small_index_takes_few_partitions(spark, ranges):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    ranges(200)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    idx = S.with_row_index(spark.range(15).withColumnRenamed("id", "k"), ["k"], "rn")
    # the index is made when it is read, so the rows are asked for it
    assert idx.select(F.spark_partition_id().alias("p"), "rn").filter("rn > 0").select("p").distinct().count() == 1 and old


@pytest.mark.parametrize("block", [5, 17, 1000])
def test_block_window_matches_naive(data, block):
    idx = S.with_row_index(data, ["k", "tb"], "rn")
    w = Window.orderBy("rn")
    naive = idx.select("rn", F.sum("x").over(w.rowsBetween(-3, 2)).alias("s0"),
                       F.lag("x", 2).over(w).alias("l0"))
    got = S.block_window(idx, "rn", 3, 2, lambda ws: {
        "s": F.sum("x").over(ws.rowsBetween(-3, 2)), "l": F.lag("x", 2).over(ws)}, block_rows=block)
    j = got.join(naive, "rn")
    assert j.count() == 300
    assert j.filter(~F.col("s").eqNullSafe(F.col("s0")) & (F.abs(F.col("s") - F.col("s0")) > 1e-9)).count() == 0
    assert j.filter(~F.col("l").eqNullSafe(F.col("l0"))).count() == 0


@pytest.mark.parametrize("block,fan", [(7, 1000), (7, 3), (1, 2)])
def test_prefix_sum(data, block, fan):
    idx = S.with_row_index(data, ["k", "tb"], "rn")
    got = S.prefix_sum(idx, "rn", F.coalesce("x", F.lit(0.0)), "cs", block_rows=block, fan=fan)
    assert got.count() == 300
    naive = idx.select("rn", F.sum(F.coalesce("x", F.lit(0.0))).over(
        Window.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)).alias("cs0"))
    assert got.join(naive, "rn").filter(F.abs(F.col("cs") - F.col("cs0")) > 1e-9).count() == 0


def test_rank_within(data):
    d = data.select("k", "tb").distinct()
    got = S.rank_within(d, ["k"], ["tb"], "r")
    naive = d.withColumn("r0", F.dense_rank().over(Window.partitionBy("k").orderBy("tb")))
    assert got.join(naive, ["k", "tb"]).filter(F.col("r") != F.col("r0")).count() == 0


def test_exact_quantiles_match_percentile(data):
    from fathom.operators.aggregates import exact_quantiles
    got = exact_quantiles(data, "x", {"q1": 0.1, "q5": 0.5, "q9": 0.93}, ["k"])
    naive = data.groupBy("k").agg(F.percentile("x", 0.1).alias("p1"), F.percentile("x", 0.5).alias("p5"),
                                  F.percentile("x", 0.93).alias("p9"))
    j = naive.join(got, "k", "left")
    for a, b in [("q1", "p1"), ("q5", "p5"), ("q9", "p9")]:
        assert j.filter(~F.col(a).eqNullSafe(F.col(b)) & (F.abs(F.col(a) - F.col(b)) > 1e-9)).count() == 0


def test_quantiles_of_groups_with_nulls(spark):
    from fathom.operators.aggregates import exact_quantiles
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", 3.0), ("c", 1.0), ("c", None), (None, 5.0), ("d", float("nan"))],
                               "k string, x double")
    skip = {r["k"]: r["q"] for r in exact_quantiles(df, "x", {"q": 0.5}, ["k"]).collect()}
    assert skip == {"a": None, "b": 2.0, "c": 1.0, None: 5.0, "d": None}
    strict = {r["k"]: r["q"] for r in exact_quantiles(df, "x", {"q": 0.5}, ["k"], nulls="propagate").collect()}
    assert strict == {"a": None, "b": 2.0, "c": None, None: 5.0, "d": None}
    assert exact_quantiles(df.limit(0), "x", {"q": 0.5}).collect()[0]["q"] is None


def test_rank_within_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "k string, v long")
    got = sorted((r["k"], r["v"], r["r"]) for r in S.rank_within(df, ["k"], ["v"], "r").collect()
                 if r["k"] is None)
    assert got == [(None, 1, 1), (None, 3, 2)]


def test_exact_quantiles_hot_group_spreads_over_partitions(spark, ranges):
    """A third of the rows share one group and one value: the index still splits them
    across partitions (the tiebreak orders them) and the quantiles stay exact."""
    from fathom.operators.aggregates import exact_quantiles
    rows = [("hot", 5.0)] * 300 + [("hot", float(i)) for i in range(300)] + \
        [(f"g{i % 7}", float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, x double")
    ranges(4)
    idx = S.with_row_index(df.filter("k = 'hot' AND x = 5.0").withColumn("tb", F.monotonically_increasing_id()),
                           ["k", "x", "tb"], "rn")
    sizes = [r["count"] for r in idx.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 301
    got = exact_quantiles(df, "x", {"q": 0.3, "m": 0.5}, ["k"])
    naive = df.groupBy("k").agg(F.percentile("x", 0.3).alias("q0"), F.percentile("x", 0.5).alias("m0"))
    j = got.join(naive, "k")
    assert j.count() == 8
    assert j.filter((F.abs(F.col("q") - F.col("q0")) > 1e-9) | (F.abs(F.col("m") - F.col("m0")) > 1e-9)).count() == 0


# ---------------------------------------------------------------- keyed series, index without a write

@pytest.fixture(scope="module")
def keyed(spark):
    """One long series, many short ones, a null key."""
    rnd = random.Random(11)
    keys = ["long"] * 150 + [None] * 9 + [f"s{i % 40}" for i in range(100)]
    rows = [(k, i, rnd.choice([None, rnd.random(), 0.5]), rnd.random() < 0.4, rnd.random()) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "k string, t long, x double, f boolean, y double")


def series_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.t):
        out.setdefault(r.k, []).append(r)
    return out


@pytest.mark.parametrize("block", [30, 1000])
def test_keyed_windows_stay_in_their_series(keyed, block):
    idx = S.with_row_index(keyed, ["k", "t"], "rn", range_rows=40)
    assert sorted(r.rn for r in idx.collect()) == list(range(1, keyed.count() + 1))
    df = S.moving_mean(idx, "rn", ["x", "y"], 5, block_rows=block, by=["k"])
    df = S.diff0(df, "rn", ["y"], block_rows=block, by=["k"])
    df = S.dilate(df, "rn", "f", "wide", 4, 1, block_rows=block, by=["k"])
    df = S.label_runs(df, "rn", "f", "run", block_rows=block, by=["k"])
    got = {r.t: r for r in df.collect()}
    assert len(got) == keyed.count()
    for rows in series_of(keyed.collect()).values():
        run = 0
        for i, r in enumerate(rows):
            g = got[r.t]
            pad = [rows[min(max(j, 0), len(rows) - 1)] for j in range(i - 2, i + 3)]
            for c in ("x", "y"):
                vals = [p[c] for p in pad]
                want = None if None in vals else sum(vals) / 5
                assert g[f"{c}_smooth"] == (None if want is None else pytest.approx(want, abs=1e-12))
            assert g.dy == pytest.approx(r.y - rows[i - 1].y if i else 0.0)
            ahead = 1 if i + 1 >= 4 else 0
            assert g.wide == any(p.f for p in rows[max(0, i - 4):i + 1 + ahead])
            run += r.f and not (i and rows[i - 1].f)
            assert g.run == (run if r.f else 0)


def test_keyed_cross_corr_equals_each_series_alone(keyed):
    idx = S.with_row_index(keyed, ["k", "t"], "rn", range_rows=40)
    got = {(r.k, r.lag): r.acf for r in S.cross_corr(idx, "rn", "x", "y", 2, block_rows=20, by=["k"]).collect()}
    for k in ("long", None, "s3"):
        own = S.with_row_index(keyed.filter(F.col("k").eqNullSafe(F.lit(k))), ["t"], "rn")
        for r in S.cross_corr(own, "rn", "x", "y", 2).collect():
            assert got[k, r.lag] == (None if r.acf is None else pytest.approx(r.acf, abs=1e-12))


def test_index_writes_nothing_and_is_the_same_when_computed_again(spark, data, ranges, tmp_path):
    ranges(8)
    src = f"{tmp_path}/t"
    data.write.parquet(src)
    df = spark.read.parquet(src)
    folder = spark.sparkContext.getCheckpointDir()

    def files():
        import os
        return sum(len(f) for _, _, f in os.walk(folder.removeprefix("file:")))

    before = files()
    idx = S.with_row_index(df, ["k", "tb"], "rn", range_rows=30)
    first, again = sorted(map(tuple, idx.collect()), key=str), sorted(map(tuple, idx.repartition(5).collect()), key=str)
    assert first == again and files() == before
    plan = idx._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan.split("BroadcastExchange")[0] and "FileScan parquet" in plan
    other = S.with_row_index(df, ["k", "tb"], "rn", range_rows=7)        # other bounds, same index
    assert sorted(map(tuple, other.collect()), key=str) == first

"""Physical-plan properties: pushdown, pruning, no single-task windows, Python only in G3/G4/S3."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
PY_NODES = ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInArrow", "MapInPandas")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    import contextlib
    import io
    df = entry.queries()["range_filter"](spark, SF)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    plan = buf.getvalue()
    assert "GreaterThan(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    assert "GreaterThan(l_extendedprice,2000.0)" in plan
    # 5 of lineitem's 11 columns are read
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double," \
           "l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan


@pytest.mark.parametrize("name", ["series_diff_join", "dilate", "bout_table", "bouts_label"])
def test_ordered_operators_have_no_single_partition_exchange(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "SinglePartition" not in plan
    assert not any(p in plan for p in PY_NODES)


@pytest.mark.parametrize("name", ["daily_summary", "migration", "profiles", "ols_many", "cross_corr"])
def test_no_python_outside_components_and_watershed(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert not any(p in plan for p in PY_NODES)


def test_watershed_is_the_grouped_map(spark):
    from fathom.operators.watershed import watershed
    df = spark.createDataFrame([("a", 1, 1, -50.0, 1), ("a", 2, 1, -70.0, 0)],
                               "g string, xi int, yi int, Sv_mean double, comp long")
    out = watershed(df, ["g"])
    assert "FlatMapGroupsInPandas" in plan_of(out)
    assert out.columns == ["g", "xi", "yi", "Sv_mean", "label"]


def test_crop_limits_reach_the_scan(spark, tmp_path):
    from fathom.operators.relational import crop
    spark.range(100).selectExpr("id as x", "cast(id as double) as y").write.parquet(f"{tmp_path}/t")
    plan = plan_of(crop(spark.read.parquet(f"{tmp_path}/t"), "x", "y", None, (7.0, 3.0)))
    assert "GreaterThanOrEqual(y,3.0)" in plan and "LessThanOrEqual(y,7.0)" in plan and "Join" not in plan


def test_slice_near_the_start_is_a_top_n(spark):
    df = spark.range(50_000).selectExpr("(id * 7919) % 50000 as k")
    from fathom.operators.relational import row_slice
    out = row_slice(df, ["k"], 11, 20)
    assert "TakeOrderedAndProject" in plan_of(out) and [r.k for r in out.orderBy("k").collect()] == list(range(10, 20))
    import fathom.operators.relational as R
    big, R.SLICE_ROWS = R.SLICE_ROWS, 5
    try:
        assert sorted(map(tuple, row_slice(df, ["k"], 11, 20).collect())) == sorted(map(tuple, out.collect()))
    finally:
        R.SLICE_ROWS = big

"""Every registered query against its DuckDB oracle at the smallest scale.

``FATHOM_ORACLE=all`` runs all queries; by default a representative subset runs."""

import os

import pytest

import __spark_entry__ as entry
from tools.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
SUBSET = ["daily_summary", "migration", "bout_table", "cross_corr", "moving_mean", "components",
          "segment_stats", "layer_metrics", "ols_many", "profiles", "interval_join", "rescale_overlay",
          "group_quantiles", "histogram", "row_slice", "csv_scan", "median_nulls", "relabel_zone", "detect_demo",
          "series_moving_mean", "series_bouts", "series_cross_corr", "interval_index", "csv_directory", "feather_ingest",
          "prey_groups"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("FATHOM_ORACLE") == "all" else SUBSET


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF).toArrow()
    want = con.sql(entry.oracle_sql()[name]).arrow()
    if hasattr(want, "read_all"):
        want = want.read_all()
    ok, why = compare(got, want)
    assert ok, why


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "nschools" in df.columns


def test_every_query_of_the_reference_has_an_oracle():
    from fathom.plans.catalog import load_all
    assert set(load_all()) <= set(entry.oracle_sql())

"""Every registered query of the subpackage against its SQL, and the ones without SQL run."""

import pytest

import __spark_entry__ as entry
from fathom.llm.queries import QUERIES, SQL
from tests.llm.helpers import SF
from tools.oracle_check import compare, duck


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, SF).toArrow()
    want = duck(SF).sql(SQL[name]).arrow()
    ok, why = compare(got, want.read_all() if hasattr(want, "read_all") else want)
    assert ok, why

"""Every registered query against its DuckDB oracle on the smallest scale (the driver uses sf0.01)."""

import os
import sys

import pytest

from conftest import SF_SMOKE

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare  # noqa: E402


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["category", "n_docs"] and df.count() >= 0


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, name):
    r = compare(spark, SF_SMOKE, name, E.queries()[name], E.oracle_sql().get(name))
    if r.get("oracle") is False:
        assert r["rows"] >= 0
        return
    assert r["schema_ok"], r
    assert r["rows"] == r["oracle_rows"], r
    assert r["values_ok"], r


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cross_or_nested_loop_join(spark, name):
    from plans import plan_facts
    assert plan_facts(E.queries()[name](spark, SF_SMOKE))["cross"] == 0

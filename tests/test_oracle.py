"""Every registered query equals its DuckDB oracle on the derived test tables."""

import os

import pytest

import __spark_entry__ as entry
from callqc import registry
from tools import oracle_check

SF_DIRS = os.environ.get("CALLQC_TEST_SF", "/root/testdata/sf0.001").split(",")
KEYS = sorted(registry.queries())


def test_every_query_has_an_oracle():
    assert set(registry.oracle_sql()) == set(registry.queries())


@pytest.mark.parametrize("sf_dir", SF_DIRS)
def test_oracle_parity(spark, sf_dir):
    results = oracle_check.check(spark, sf_dir, KEYS, verbose=False)
    bad = {k: v for k, v in results.items() if v[0] != "OK"}
    assert not bad, bad


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 0
    assert df.columns == entry.entry(spark).columns

"""Every registered query against its SQL on the smallest sample tables."""

import os

import pytest

import check_oracle
from __spark_entry__ import entry, oracle_sql, queries

SAMPLE = "/root/testdata/sf0.001"
needs_sample = pytest.mark.skipif(not os.path.isdir(SAMPLE), reason="sample tables are not here")


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 100


@needs_sample
def test_entry(spark):
    assert entry(spark).count() > 0


@needs_sample
@pytest.mark.parametrize("name", sorted(queries()) if os.path.isdir(SAMPLE) else [])
def test_query(spark, name):
    assert check_oracle.compare(spark, SAMPLE, [name]) == 0

"""Every registered query against its SQL check."""

import pytest

import __spark_entry__ as entry
from fleetfold import workload
from tools.check_oracles import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(workload.queries()))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    assert name in entry.oracle_sql()
    assert compare(spark, con, name, sf_dir, may_be_empty=True) == []


def test_entry_gives_the_flagship_row(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["n"] == 1000

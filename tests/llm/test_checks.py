"""Queries of this subpackage against their SQL."""

import pytest

from fleetfold.llm import oracle_sql
from tools.check_oracles import compare, connect


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), name, sf_dir) == []

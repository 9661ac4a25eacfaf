import pytest

import __spark_entry__ as entry_module
from checks.compare import connect, difference
from checks.oracles import oracle_sql
from checks.queries import QUERIES
from checks.spec import SPECS

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_sql_and_a_spec():
    assert set(QUERIES) == set(oracle_sql()) == set(SPECS)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(SPECS) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(SPECS))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, SMALL, name) == ""


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["config", "time", "k", "depth", "w_est", "w_model", "bias"]
    assert df.count() > 0

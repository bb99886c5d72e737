"""Every registered query of the engine against its SQL."""

import pytest

from basewright.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import same_as_sql


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    same_as_sql(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0

import oracle
import pytest

from tarnwell.plans import enrichment, inferring, queries, writing  # noqa: F401 - registers queries
from tarnwell.plans.registry import QUERIES, SQL


@pytest.fixture(scope="session")
def con(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, con, name):
    assert oracle.spark_rows(QUERIES[name](spark, sf)) == oracle.sql_rows(con, SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

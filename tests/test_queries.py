"""Every grid query against its SQL, the others for their rows, on the smallest tables."""

import pytest

from gridframe import queries_coverage  # noqa: F401
from gridframe.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(compare, name):
    compare(QUERIES[name], SQL[name], DIR)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and f"{n}_holds" not in SQL))
def test_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

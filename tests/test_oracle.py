"""Each query against its SQL on the smallest tables."""
import pytest

import __spark_entry__ as entry
from tests.oracle_check import connect, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equal(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert same(got, connect(SF).execute(entry.oracle_sql()[name]).df()) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="tables are not here")
def test_flagship(spark):
    found = entry.entry(spark)
    assert found.columns == ["id", "score"] and found.count() == 10


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

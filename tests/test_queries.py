import pytest
from oracle import compare

from segspark.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), SQL[name], SF) > 0

import pytest
from oracle import assert_same

from loomglass.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_equal_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), queries.SQL[name], sf)

"""Text queries with a DuckDB statement against it."""

import pytest
from compare import connect, differences
from texelyard.llm.oracle import ORACLE
from texelyard.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_query_matches(spark, name, sf):
    found = differences(connect(sf), ORACLE[name], QUERIES[name](spark, sf))
    assert found is None, found

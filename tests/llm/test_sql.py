import pytest

from heliogrid.llm import queries
from tests.compare import same
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    ok, why = same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)
    assert ok, why

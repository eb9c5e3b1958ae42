import pytest

from lodestow.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(name, spark, sf, same):
    same(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name])

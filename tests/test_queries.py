import pytest

import __spark_entry__
from lodestow.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(name, spark, sf, same):
    same(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name])


def test_entry_returns_rows(spark):
    assert __spark_entry__.entry(spark).count() == 5


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    from lodestow.plans.views import load

    docs = load(spark, sf, "documents").where("doc_id = 17").select("doc_id", "n_chars")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,17)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_every_commit_has_a_version(spark, sf):
    commits = queries.op_log(spark, sf).where("op = 'commit'").count()
    found = queries.QUERIES["every_version"](spark, sf).select("key", "seq").distinct().count()
    assert found == commits

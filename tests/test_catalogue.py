import pytest

from assayer.plans import catalogue

from .compare import by_spark, by_sql


@pytest.mark.parametrize("name", list(catalogue.CASES))
def test_query_equals_sql(spark, sf_dir, name):
    query, sql = catalogue.CASES[name]
    got = by_spark(query(spark, sf_dir))
    if sql:
        names, rows = by_sql(sql, sf_dir)
        assert got[0] == names
        assert got[1] == rows

import pytest
from oracle import check

from folio.plans.formats import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0

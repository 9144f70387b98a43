import sys
from pathlib import Path

import pytest

from folio.llm.registry import ORACLE_SQL, QUERIES

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import check  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name])

import pytest
from checks import SF, rows_of_frame, rows_of_sql

from vexel.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert rows_of_frame(queries.QUERIES[name](spark, SF)) == rows_of_sql(queries.ORACLE_SQL[name])

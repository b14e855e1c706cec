import pytest

from tallyloom.oracle import ORACLE_SQL
from tallyloom.queries import QUERIES
from tests.compare import duck, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    columns, want = duck(sf_dir, ORACLE_SQL[name])
    got_columns, got = spark_rows(QUERIES[name](spark, sf_dir))
    assert got_columns == columns
    assert got == want

import os

import pytest
from oracle import SF, compare

from atomloom.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"stream_ingest", "bench_run"}))
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)

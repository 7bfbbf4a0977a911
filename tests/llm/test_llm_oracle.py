import os

import pytest
from oracle import SF, compare

from atomloom.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() >= (name != "p8_found")  # the smallest tables hold no text that fits no container

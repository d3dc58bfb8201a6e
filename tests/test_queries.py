import os

import pytest

from claimveil.oracles import ORACLES
from claimveil.queries import QUERIES
from tests.compare import SF_DIR, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_agree(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0

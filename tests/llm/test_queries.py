import os

import pytest

from claimveil.llm.registry import ORACLES, QUERIES
from tests.compare import SF_DIR, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_agree(spark, name):
    same(spark, QUERIES[name], ORACLES[name])

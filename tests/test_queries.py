"""Every query against its SQL twin; those without one must run."""

import pytest
from compare import difference

from tuyere.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE_SQL:
        assert difference(spark, QUERIES[name], ORACLE_SQL[name], SF) == ""
    else:
        assert QUERIES[name](spark, SF).count() > 0

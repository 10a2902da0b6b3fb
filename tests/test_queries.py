from __future__ import annotations

import pytest

from keyfold import queries as Q
from tests.compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.FOUND))
def test_query_says_what_its_sql_says(spark, name):
    f, sql = Q.FOUND[name]
    same(f(spark, SF), sql, SF)

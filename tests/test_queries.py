"""Every registered query against its SQL, whole tables; those without SQL give rows."""

import pytest

from nearfield.plans.registry import load_all
from tests.oracle import SF, assert_same

CORE = load_all()


@pytest.mark.parametrize("name", CORE)
def test_query(spark, name):
    q = CORE[name]
    df = q.run(spark, SF)
    if q.sql:
        assert_same(df, q.sql)
    else:
        assert df.count() > 0

"""Every query with an SQL twin, compared at the smallest size; the others return rows. None may be empty."""

import pytest

from quaystone.plans import every
from tests.harness import compare, connect

#: The second is used where the first has no rows for a query.
SIZES = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return {sf: connect(sf) for sf in SIZES}


@pytest.mark.parametrize("name", sorted(every.queries()))
def test_query(spark, con, name):
    for sf in SIZES:
        df = every.queries()[name](spark, sf)
        sql = every.oracle_sql().get(name)
        found = compare(df, con[sf], sql) if sql else ["no rows"] * (df.count() == 0)
        if found != ["no rows"]:
            break
    assert found == []

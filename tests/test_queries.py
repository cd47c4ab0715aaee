"""Every query of the catalogue against its SQL."""

import pytest
from compare import assert_same

from lodestone.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert_same(df, duck.sql(SQL[name]))
    else:
        assert df.count() >= 0

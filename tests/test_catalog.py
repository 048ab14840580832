"""Every registered query of the library against its DuckDB SQL."""

import pytest

from convolens.plans import adapters, catalog

from .compare import connect, differences

QUERIES, ORACLE = catalog.QUERIES | adapters.QUERIES, catalog.ORACLE | adapters.ORACLE


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        assert differences(df, db, ORACLE[name]) == []
    else:
        assert df.count() > 0

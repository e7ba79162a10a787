"""Every registered query of the engine against its SQL at the smallest scale."""

from __future__ import annotations

import pytest

from tesserae import catalog
from tests.oracle import DATA, connect, differences

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return connect("sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    assert not differences(catalog.QUERIES[name](spark, f"{DATA}/sf0.001"), catalog.ORACLE_SQL[name], con)


def test_stream_equals_batch(spark):
    sf = f"{DATA}/sf0.001"
    a, b = (sorted(map(tuple, catalog.QUERIES[q](spark, sf).select("peer", "balance", "reserved", "refused", "events").collect())) for q in ("accounts", "account_stream"))
    assert a == b


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())

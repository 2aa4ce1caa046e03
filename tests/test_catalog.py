"""Every query against its SQL on the smallest tables."""

import pytest
from oracle import connection, difference

from ratelens.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        assert difference(df, duck, catalog.SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry_and_names():
    import __spark_entry__ as driver

    assert set(catalog.QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


def test_flags_has_all_its_columns(spark, duck):
    """A rewrite of the query and its SQL had dropped the number of points from both."""
    df = catalog.QUERIES["flags"](spark, SF)
    assert df.columns == duck.sql(catalog.SQL["flags"]).columns == ["doc_id", "toxic", "good", "points"]
    assert {r.points for r in df.collect()} == {16}

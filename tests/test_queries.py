import pytest

from spanloom.plans import catalog, diagnose, dictionaries, documents, mining, models, selection  # noqa: F401
from tests.parity import compare, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, con, name):
    compare(spark, con, SF, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"o_cross_validated_models"}))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

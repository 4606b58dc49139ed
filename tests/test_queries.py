"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest
from compare import compare, duck
from conftest import SMALL

from fieldledger.plans import REGISTRY

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="shared tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SMALL, REGISTRY[name]) == ""


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    without = set(REGISTRY) - set(entry.oracle_sql())
    assert without == set()


def test_materialised_tables_use_the_named_folder(spark, tmp_path_factory):
    from fieldledger.operators.lineage import materialise, shared_folder

    folder = shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    kept = materialise(spark.range(5))
    assert kept.count() == 5 and len(set(os.listdir(folder)) - before) == 1

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from oracle import FOLDER, HERE, agrees, connection  # noqa: E402

from lattica.plans import registry  # noqa: E402

pytestmark = pytest.mark.skipif(not HERE, reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) & set(registry.ORACLE)))
def test_query_equals_sql(spark, con, name):
    assert agrees(spark, con, registry.QUERIES[name], registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_points(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0

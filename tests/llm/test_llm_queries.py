import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import FOLDER, HERE, agrees, connection  # noqa: E402

from lattica.llm import registry  # noqa: E402

pytestmark = pytest.mark.skipif(not HERE, reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, con, name):
    assert agrees(spark, con, registry.QUERIES[name], registry.ORACLE[name])


COLUMNS = {
    "p1_found": ["paper_id", "node_id"], "p2_found": ["document_id", "field_name", "line_no", "kind"], "p3_found": ["mention_id_1", "mention_id_2"],
    "p5_found": ["table_name", "first_key", "copy_key"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "shared_chars"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert df.columns == COLUMNS[name] and rows
    if name != "p6_ids":
        assert len(set(rows)) == len(rows)

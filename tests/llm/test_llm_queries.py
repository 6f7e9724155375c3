"""The queries of the training-text operators: against their SQL, or on their own where SQL cannot say it."""

import pytest
from query_check import DIR, compare, connection

from spanloom.llm.queries import LLM

SHAPES = {
    "p4_found": ["rec_table", "rec_field", "rec_id", "kind"],
    "p5_found": ["comment_id", "consensus"],
    "p8_found": ["doc_id", "item_id"],
    "p9_found": ["source"],
    "p10_found": ["doc_id_a", "doc_id_b"],
}


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(LLM.sql))
def test_against_sql(spark, con, name):
    compare(spark, con, name, LLM.queries[name], LLM.sql[name])


@pytest.mark.parametrize("name", sorted(set(LLM.queries) - set(LLM.sql)))
def test_without_sql(spark, name):
    df = LLM.queries[name](spark, DIR)
    rows = df.collect()
    assert rows and (name not in SHAPES or df.columns == SHAPES[name])
    if name in SHAPES:
        assert len(set(rows)) == len(rows) and all(v is not None for r in rows for v in r)

import os

import pytest
from oracle import FOLDER, rows_by_sql, rows_of

from strataloom.plans import all_oracles, all_queries

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
QUERIES, ORACLES = all_queries(), all_oracles()


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert rows_of(QUERIES[name](spark, FOLDER)) == rows_by_sql(ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_twin(spark, name):
    """Rows as named, and the same in every run: nothing depends on where rows lie."""
    df = QUERIES[name](spark, FOLDER)
    cols, rows = rows_of(df)
    assert cols == sorted(df.columns) and rows_of(QUERIES[name](spark, FOLDER)) == (cols, rows)
    assert rows or name in ("doc_links",)  # the smallest folder has no links between its documents


@pytest.mark.parametrize("name", ["bm25_topk", "neighborhood", "p4_found", "p5_found", "semantic_diff", "text_packs"])
def test_partitioning_changes_nothing(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        one = rows_of(QUERIES[name](spark, FOLDER))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert rows_of(QUERIES[name](spark, FOLDER)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_cross_joins(spark):
    for name, q in QUERIES.items():
        plan = q(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name

"""How the queries on the shared ranking meet the documents."""

import os

import oracle
import pytest

from quarrylight.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.TABLES), reason="no tables")


@pytest.fixture
def wide(spark):
    """Nothing is broadcast for its estimated size, as on large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e5_budget_sweep", "r15_parent_fill"])
def test_documents_are_not_shuffled_to_meet_hits(wide, name):
    told = plan(catalog.QUERIES[name](wide, oracle.TABLES))
    assert "BroadcastHashJoin [chunk_id" in told and "SortMergeJoin [chunk_id" not in told and "MapInArrow" not in told


@pytest.mark.parametrize("name", ["e4_score_items", "a5_partial_covers_strict", "a6_coverage", "f16_scope_label"])
def test_texts_are_not_read_again_by_the_last_plan(spark, name):
    files = [f for f in catalog.QUERIES[name](spark, oracle.TABLES).inputFiles() if "documents.parquet" in f]
    assert files == []


@pytest.mark.parametrize("name", ["f16_scope_label", "a24_ndcg"])
def test_needles_meet_texts_once(spark, name):
    assert "Contains(" not in plan(catalog.QUERIES[name](spark, oracle.TABLES))

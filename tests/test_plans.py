"""Shapes of physical plans that matter at scale."""

import inspect

import pytest

from vacantia.plans import catalog
from vacantia.sources import adapters

FOLDER = "/root/testdata/sf0.001"


def plan_of(rows):
    return rows._jdf.queryExecution().explainString(
        rows.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


NATIVE = ["clean_text", "normalize_postings", "classify_category", "extract_skills", "chunk_documents", "prepare_postings",
          "upsert_actions", "search_postings", "top_skills", "top_terms", "latency_summary", "skills_per_posting"]


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_cartesian_product(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, FOLDER))
    for word in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan, word


@pytest.mark.parametrize("name", ["dedup_first_by_key", "upsert_actions", "prepare_postings", "knn_topk", "recommend_topn"])
def test_rank_limits_run_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan_of(catalog.QUERIES[name](spark, FOLDER))


def test_scan_reads_needed_columns_and_pushes_the_id(spark):
    assert "ReadSchema: struct<doc_id:bigint,lang:string" not in plan_of(catalog.parse_listed_date(spark, FOLDER))
    assert "EqualTo(doc_id,42)" in plan_of(catalog.get_posting(spark, FOLDER))


def test_chunking_runs_once(spark):
    """The optimizer must not add a second evaluation of the chunk fold as a filter."""
    plan = catalog.chunk_documents(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 2 and "Filter ((size(" not in plan


def test_queries_read_whole_tables():
    source = inspect.getsource(adapters)
    assert ".sample(" not in source and ".limit(" not in source

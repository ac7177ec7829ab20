"""What the plans must and must not hold."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tagspark.operators import browse, diff, planning, scores, scoring
from tagspark.plans import queue_queries as Q
from tagspark.plans.catalog import QUERIES, checking_sql
from tagspark.plans.library import Library

FOLDER = "/root/testdata/sf0.001"
# Queries that run streams, or write an intermediate table first, when they are built.
EAGER = {n for n in QUERIES if n.startswith(("stream_", "log_session", "session_report", "assign_", "batch_", "progress_", "score_pending", "learning_split_"))}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lib(spark):
    return Library(spark, FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_query_pairs_all_rows_or_gathers_them(spark, name):
    """No pairing of all rows and no row-by-row Python; and below a single-task exchange there is
    an aggregation, or a limit that is the feature."""
    plan = plan_of(QUERIES[name](spark, FOLDER))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "MapInPandas"):
        assert word not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = next(text for text in lines[i + 1 :] if "Project" not in text)
            assert re.search(r"Aggregate|LocalLimit|GlobalLimit|TakeOrdered", below), below


def test_every_query_is_checked():
    assert set(checking_sql()) == set(QUERIES)


def test_only_needed_columns_and_filters_reach_the_scan(lib):
    plan = plan_of(browse.search_files(lib.files, lib.file_tags, ["system:archive", "red ring"]).select("file_id"))
    assert "o_totalprice" not in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan
    stored = lib.spark.createDataFrame([], "file_id bigint, service_key string, status string, pos bigint, tag string, tag_norm string")
    assert "StartsWith" in plan_of(planning.max_marker_tier(stored))


def test_stored_marker_filter_is_pushed_down(lib, tmp_path):
    lib.file_tags.write.parquet(str(tmp_path / "tags"))
    stored = lib.spark.read.parquet(str(tmp_path / "tags"))
    lib.spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(planning.max_marker_tier(stored, "svc1"))
    assert "StringStartsWith(tag_norm,wd14:)" in plan and "EqualTo(service_key,svc1)" in plan


def test_diff_shuffles_each_side_once(spark, lib, tmp_path):
    lib.file_tags.write.parquet(str(tmp_path / "tags"))
    lib.proposed.write.parquet(str(tmp_path / "proposed"))
    tags, proposed = spark.read.parquet(str(tmp_path / "tags")), spark.read.parquet(str(tmp_path / "proposed"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(diff.filter_new_tags(proposed, tags, "svc1"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def test_thresholds_do_not_shuffle_vectors(lib):
    plan = plan_of(scores.threshold_scores(lib.scores, lib.tag_labels))
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Generate" not in main


def test_skipped_files_never_reach_the_classifier(lib):
    def make():
        return lambda x: x

    media = lib.table("embeddings").select(F.col("vec_id").alias("file_id"), "embedding")
    rows = media.where("file_id % 2 = 0")
    plan = plan_of(scoring.score_files(rows, make, ["embedding"], input_tensor_shapes=[[64]]))
    assert plan.index("ArrowEvalPython") < plan.index("% 2) = 0")
    assert plan.count("ArrowEvalPython") == 1


def test_each_file_is_scored_once(spark):
    plan = plan_of(QUERIES["score_pending"](spark, FOLDER))
    assert plan.count("ArrowEvalPython") == 1


def test_plan_counts_equal_bucket_sizes(lib):
    decisions = planning.skip_decisions(lib.queue, lib.files, lib.file_tags, Q.RULES)
    plan = planning.queue_plan(lib.queue, lib.files, lib.file_tags, Q.RULES).first()
    sizes = {r["bucket"]: r["count"] for r in planning.reorder_infer_first(decisions).groupBy("bucket").count().collect()}
    assert [sizes[b] for b in range(3)] == [plan["infer_total"], plan["skip_same_marker"], plan["skip_higher_tier"]]

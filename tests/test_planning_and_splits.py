"""Skip planning, run order, calibration splits, batches."""

from __future__ import annotations

import itertools
import math

import pytest
from conftest import got, table
from pyspark.sql import functions as F

from tagspark.functions.text import normalize_tag
from tagspark.operators import planning as P
from tagspark.operators import skew, splits as S

TAGS = "file_id bigint, service_key string, status string, pos bigint, tag string"


def tags_of(spark, *rows):
    return table(spark, TAGS, *rows).withColumn("tag_norm", normalize_tag("tag"))


def queue_of(spark, ids):
    return table(spark, "pos bigint, file_id bigint", *enumerate(ids))


def ids_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "file_id bigint")


@pytest.fixture(scope="module")
def tagged(spark):
    return tags_of(
        spark,
        (2, "svc", "0", 0, "wd14:wd-vit-tagger-v3"),
        (3, "svc", "1", 0, "WD14: wd_eva02_large_tagger_v3 "),
        (3, "svc", "0", 0, "wd14:custom"),
        (4, "other", "0", 0, "wd14:wd-vit-tagger-v3"),
        (5, "svc", "0", 0, "blue hair"),
    )


def test_queue_of_three_is_reordered(spark, tagged):
    queue, files = queue_of(spark, [3, 1, 2]), ids_of(spark, [1, 2, 3])
    ordered = P.reorder_infer_first(P.skip_decisions(queue, files, tagged))
    assert [r["file_id"] for r in ordered.orderBy("ordinal").collect()] == [1, 2, 3]


def test_missing_metadata_counts_as_infer(spark, tagged):
    plan = P.queue_plan(queue_of(spark, [1, 9, 9, 3]), ids_of(spark, [1, 3]), tagged).first()
    assert tuple(plan) == (4, 3, 0, 1, 2)


def test_markers_of_unknown_files_do_not_skip(spark, tagged):
    plan = P.queue_plan(queue_of(spark, [2, 3]), ids_of(spark, []), tagged).first()
    assert plan["infer_total"] == 2 and plan["missing_metadata"] == 2


@pytest.mark.parametrize(
    "rules, same, higher",
    [
        ({}, 2, 1),
        ({"service_key": "svc"}, 1, 1),
        ({"skip_same": False}, 0, 1),
        ({"skip_higher": False}, 2, 0),
        # The stored marker has a space after its colon: no match by text, but its rank is read.
        ({"model": "wd_eva02_large_tagger_v3"}, 0, 0),
        ({"model": "unknown"}, 0, 3),
        ({"marker_template": "blue_hair"}, 1, 1),
    ],
)
def test_skip_rules(spark, tagged, rules, same, higher):
    queue, files = queue_of(spark, [1, 2, 3, 4, 5]), ids_of(spark, range(1, 6))
    run = P.SkipRules(**rules)
    plan = P.queue_plan(queue, files, tagged, run).first()
    assert (plan["skip_same_marker"], plan["skip_higher_tier"]) == (same, higher)
    decisions = P.skip_decisions(queue, files, tagged, run)
    assert P.plan_counts(decisions).first() == plan


def test_hot_queue_id_keeps_every_row(spark, tagged):
    hot = spark.range(9000).select(
        F.col("id").alias("pos"), F.when(F.col("id") % 3 < 2, F.lit(2)).otherwise(F.col("id")).alias("file_id")
    )
    decisions = P.skip_decisions(hot, ids_of(spark, [1, 2, 3]), tagged)
    assert decisions.count() == 9000
    # Two thirds of the rows, and the row whose own number is 2.
    assert decisions.where("skip_reason = 'wd_model_marker_present'").count() == 6001


def test_max_marker_tier_first_wins(spark):
    tags = tags_of(
        spark,
        (1, "b", "0", 0, "wd14:wd-vit-large-tagger-v3"),
        (1, "a", "1", 5, "wd14:wd_vit_large_tagger_v3"),
        (1, "a", "0", 0, "wd14:wd-vit-tagger-v3"),
        (2, "a", "0", 0, "wd14:custom"),
    )
    assert got(P.max_marker_tier(tags)) == [(1, 3, "wd_vit_large_tagger_v3")]
    assert got(P.max_marker_tier(tags, "b")) == [(1, 3, "wd-vit-large-tagger-v3")]


def test_marker_present(spark, tagged):
    files = ids_of(spark, range(1, 6))
    assert got(P.marker_present(files, tagged, " WD14:wd_vit_tagger_v3 ")) == [(2,), (4,)]
    assert got(P.marker_present(files, tagged, "wd14:wd-vit-tagger-v3", "svc")) == [(2,)]
    assert got(P.marker_present(files, tagged, "  ")) == []


def test_merge_prefetch_and_validate(spark):
    queue = queue_of(spark, [1, 2, 2, 7])
    ready = table(spark, "file_id bigint, hash string", (1, "p1"), (5, "p5"))
    source = table(spark, "file_id bigint, hash string", (1, "s1"), (2, "s2"), (8, "s8"))
    assert got(P.merge_prefetch(queue, ready, source)) == [(1, "p1", "prefetch"), (2, "s2", "source")]
    ok, rejects = P.validate_queue(table(spark, "file_id string", ("1",), (" 7 ",)))
    assert got(ok) == [(1,), (7,)] and got(rejects) == []
    ok, rejects = P.validate_queue(table(spark, "file_id string", ("1",), ("7.0",)))
    assert got(ok) == [] and got(rejects) == [("invalid_request", 1)]
    _, rejects = P.validate_queue(spark.createDataFrame([], "file_id string"))
    assert got(rejects) == [("empty_queue", 0)]


# ---- splits: brute force ----------------------------------------------------------------------
def count_size(n, fraction, cap=10**9):
    if n <= 1:
        return n
    return min(max(1, min(max(32, math.ceil(fraction * n)), n - 1)), cap)


@pytest.mark.parametrize("n", [0, 1, 2, 33, 100, 1000])
@pytest.mark.parametrize("fraction", [0.05, 0.07, 0.5])
def test_learning_split_by_count(spark, n, fraction):
    queue = spark.range(n).select((F.col("id") * 3).alias("pos"), F.col("id").alias("file_id"))
    size = S.learning_size(queue, fraction).first()
    assert size["learning_count"] == count_size(n, fraction)
    if n in (33, 100):
        rows = S.learning_split(queue, fraction).orderBy("pos").collect()
        k = count_size(n, fraction)
        assert [r["segment"] for r in rows] == ["learning"] * k + ["commit"] * (n - k)
        assert [r["ordinal"] for r in rows] == list(range(n))


def test_learning_cap_moves_overflow_to_commit(spark):
    queue = spark.range(200).select(F.col("id").alias("pos"), F.col("id").alias("file_id"))
    rows = S.learning_split(queue, 0.5, cap=40)
    assert rows.where("segment = 'learning'").agg(F.count("*"), F.max("pos")).first() == (40, 39)


def byte_size(sizes, fraction):
    total = sum(sizes)
    target = max(1, math.ceil(fraction * total))
    k = next(i for i, s in enumerate(itertools.accumulate(sizes), start=1) if s >= target)
    n = len(sizes)
    return n if n == 1 else max(1, min(max(32, k), n - 1))


@pytest.mark.parametrize(
    "sizes, fraction",
    [([10] * 32 + [5000] * 8, 0.1), ([1] * 100, 0.5), ([5], 0.1), ([1000] + [1] * 60, 0.2), ([0] * 50 + [9] * 50, 0.3)],
)
def test_learning_split_by_bytes(spark, sizes, fraction):
    queue = queue_of(spark, range(len(sizes)))
    files = table(spark, "file_id bigint, size bigint", *enumerate(sizes))
    info = S.learning_size_bytes(queue, files, fraction).first()
    assert info["fallback"] is None and info["total_bytes"] == sum(sizes)
    assert info["split_index"] == byte_size(sizes, fraction)
    rows = S.learning_split_bytes(queue, files, fraction)
    assert rows.where("segment = 'learning'").count() == byte_size(sizes, fraction)
    assert rows.count() == len(sizes)


def test_byte_split_fallbacks(spark):
    queue = queue_of(spark, range(100))
    some = table(spark, "file_id bigint, size bigint", *[(i, 5) for i in range(99)])
    zero = table(spark, "file_id bigint, size bigint", *[(i, 0) for i in range(100)])
    for files, reason in ((None, "no_metadata"), (some, "missing_size"), (zero, "zero_total_bytes")):
        info = S.learning_size_bytes(queue, files, 0.05).first()
        assert (info["fallback"], info["split_index"], info["target_bytes"]) == (reason, 32, None)


def run_batches(n, size, cut, split, cap, tag_all):
    """Batch numbers as a run hands them out."""
    out, pos, batch, cap = [], 0, 0, max(32, min(2048, cap))
    while pos < n:
        batch += 1
        left = n - pos
        if tag_all and cut > 0 and pos >= cut:
            take = min(max(size, min(cap, left)), left)
        else:
            take = split - pos if split > 0 and pos < split < pos + size else size
        take = min(take, left)
        out += [batch] * take
        pos += take
    return out


@pytest.mark.parametrize("size, cap, tag_all", [(16, 50, True), (100, 32, True), (16, 50, False)])
def test_assign_batches_equals_a_run(spark, size, cap, tag_all):
    cases = list(itertools.product([0, 1, 45, 60, 64, 200, 300], [0, 37, 64, 299]))
    runs = table(spark, "cut bigint, split bigint", *cases).withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.lit(299))))
    rows = S.assign_batches(runs, size, F.col("cut"), F.col("split"), cap, tag_all).orderBy("cut", "split", "ordinal")
    ours = [r["batch"] for r in rows.collect()]
    assert ours == [b for cut, split in cases for b in run_batches(300, size, cut, split, cap, tag_all)]
    single = S.assign_batches(spark.range(300).withColumnRenamed("id", "ordinal"), size, 60, 64, cap, tag_all)
    assert [r["batch"] for r in single.orderBy("ordinal").collect()] == run_batches(300, size, 60, 64, cap, tag_all)


def test_tasks_of_a_prefetch_merge_hold_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 500)
    queue = queue_of(spark, [1] * 50).unionByName(spark.range(10_000).selectExpr("id AS pos", "id AS file_id"), allowMissingColumns=True)
    source = spark.range(20_000).selectExpr("id AS file_id", "concat('s', id) AS hash")
    ready = spark.range(0, 20_000, 2).selectExpr("id AS file_id", "concat('p', id) AS hash")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # large tables are not sent to every task
    try:
        merged = P.merge_prefetch(queue, ready, source)
        assert max(r["count"] for r in merged.groupBy(F.spark_partition_id()).count().collect()) < 1_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    wanted = {(i, f"s{i}", "source") if i % 2 else (i, f"p{i}", "prefetch") for i in range(10_000)}
    assert {tuple(r) for r in merged.collect()} == wanted and merged.count() == 10_000

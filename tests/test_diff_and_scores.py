"""Tag diff, write actions, drafts; score vectors, results, scoring."""

from __future__ import annotations

import json

import numpy as np
import pytest
from conftest import got, table
from pyspark.sql import functions as F

from tagspark.functions import taglists
from tagspark.functions.text import normalize_tag
from tagspark.operators import diff as D
from tagspark.operators import scores as R
from tagspark.operators import scoring, skew
from tagspark.operators.planning import SkipRules
from tagspark.sources.actions import action_body, write_tag_actions

PROPOSED = "file_id bigint, pos bigint, tag string"
TAGS = "file_id bigint, service_key string, status string, pos bigint, tag string"


def stored_of(spark, *rows):
    return table(spark, TAGS, *rows).withColumn("tag_norm", normalize_tag("tag"))


@pytest.fixture(scope="module")
def stored(spark):
    return stored_of(spark, (1, "s", "0", 0, "Blue-Hair"), (1, "s", "2", 0, "1girl"), (1, "t", "0", 0, "red hair"))


@pytest.fixture(scope="module")
def proposed(spark):
    return table(spark, PROPOSED, (1, 0, "blue_hair"), (1, 1, "red hair"), (1, 2, "blue hair"), (1, 3, "Red_Hair"), (2, 0, "_"), (2, 1, "-"))


def test_new_tags_keep_first_spelling_and_position(proposed, stored):
    assert got(D.filter_new_tags(proposed, stored, "s")) == [(1, 1, "red hair", "red hair"), (2, 0, "_", "")]
    assert got(D.file_diff_stats(D.tag_diff(proposed, stored, "s"))) == [(1, 4, 1, 3), (2, 2, 1, 1)]


def test_no_service_key_means_nothing_is_stored(proposed, stored):
    assert D.filter_new_tags(proposed, stored, "").count() == 3


def test_applying_twice_writes_nothing_more(spark, proposed, stored):
    new = D.filter_new_tags(proposed, stored, "s")
    written = new.select("file_id", F.lit("s").alias("service_key"), F.lit("0").alias("status"), "pos", "tag", "tag_norm")
    assert D.filter_new_tags(proposed, stored.unionByName(written), "s").count() == 0


def test_statuses_can_be_narrowed(stored):
    assert got(D.storage_keys(stored, "s")) == [(1, "1girl"), (1, "blue hair")]
    assert got(D.storage_keys(stored, "s", ["0"])) == [(1, "blue hair")]
    assert D.storage_keys(stored).count() == 3


def test_apply_stats(spark, proposed, stored):
    items = table(spark, "file_id bigint, hash string", (1, "h1"), (2, ""), (3, "h3"), (4, "h4"))
    removes = table(spark, PROPOSED, (4, 0, "old"))
    assert tuple(D.apply_stats(items, D.tag_diff(proposed, stored, "s"), "s").first()) == (4, 1, 1, 1, 3, 0)
    assert tuple(D.apply_stats(items, D.tag_diff(proposed, stored, "s"), "s", removes).first()) == (4, 2, 2, 1, 3, 0)
    assert tuple(D.apply_stats(items, D.tag_diff(proposed, stored, "s"), " ").first()) == (0, 0, 0, 0, 0, 0)
    dupes = table(spark, PROPOSED, (1, 0, "1GIRL"))
    assert D.apply_stats(items, D.tag_diff(dupes, stored, "s"), "s").first()["unchanged_all_dupes"] == 1


def test_actions_are_split_and_bodies_leave_out_empty_lists(spark, tmp_path):
    items = table(spark, "file_id bigint, hash string", (1, "h1"), (2, "h2"), (3, ""))
    adds = table(spark, PROPOSED, (1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (3, 0, "x"))
    removes = table(spark, PROPOSED, (1, 0, "old"), (2, 0, "gone"))
    actions = D.build_tag_actions(items, adds, "s", removes, tags_per_action=2)
    assert got(actions, "hash", "part", "add_tags", "remove_tags") == [
        ("h1", 0, ["a", "b"], ["old"]),
        ("h1", 1, ["c"], None),
        ("h2", 0, None, ["gone"]),
    ]
    bodies = [json.loads(r[0]) for r in actions.select(action_body()).collect()]
    assert {"hashes": ["h2"], "service_keys_to_actions_to_tags": {"s": {"1": ["gone"]}}} in bodies
    write_tag_actions(actions, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_pending_files_and_applicable(spark, proposed, stored):
    results = table(spark, "file_id bigint, skipped_inference boolean", (1, False), (2, True), (3, None))
    assert tuple(D.pending_files(results, D.tag_diff(proposed, stored, "s")).first()) == (3, 1)
    rows = table(
        spark,
        "id int, hash string, tags array<string>, remove_tags array<string>",
        (1, "h", ["a"], None), (2, "h", [], ["b"]), (3, "", ["a"], None), (4, "h", [], []), (5, None, ["a"], None),
    )
    assert got(D.applicable(rows), "id") == [(1,), (2,)]


@pytest.mark.parametrize(
    "tags", [["x", "wd14:model-b", "y", "wd14:legacy-z"], ["wd14:model_a", "wd14:model-a", " "], ["a"], ["WD14:model a", "b"]]
)
def test_marker_rows_agree_with_marker_lists(spark, tags):
    rows = table(spark, PROPOSED, *[(1, i, t) for i, t in enumerate(tags)])
    kept, removed = D.dedupe_marker_rows(rows, "wd14:model-a")
    listed = spark.createDataFrame([(tags,)], "t array<string>").select(taglists.dedupe_markers("t", "wd14:model-a").alias("r")).first()["r"]
    assert [r["tag"] for r in kept.orderBy("pos").collect()] == listed["tags"]
    assert removed.first()["removed"] == listed["removed"]


def test_draft_diff_is_exact_and_disjoint(spark):
    base = table(spark, "file_id bigint, tag string", (1, "a"), (1, "b"), (1, "b"))
    draft = table(spark, "file_id bigint, tag string", (1, "b"), (1, "A"), (1, "A"))
    assert got(D.draft_diff(base, draft)) == [(1, "A", "add"), (1, "a", "remove")]


# ---- scores -----------------------------------------------------------------------------------
LABELS = "label_idx int, tag_id int, name string, category int, count int"


def test_three_labels(spark):
    labels = table(spark, LABELS, (0, 0, "gen0", 0, 1), (1, 1, "char1", 4, 1), (2, 2, "rate_safe", 9, 1))
    scores = table(spark, "file_id bigint, probs array<float>", (7, [0.96, 0.90, 0.40]), (8, [0.35, 0.84, 0.0]))
    scored = R.threshold_scores(scores, labels)
    assert got(R.explode_predictions(scored), "file_id", "category", "tag") == [
        (7, 0, "gen0"), (7, 4, "char1"), (7, 9, "rate_safe"), (8, 0, "gen0"), (8, 9, "rate_safe"),
    ]
    results = R.build_results(scored, "wd14:m").orderBy("file_id").collect()
    assert results[0]["tags"] == ["gen0", "character:char1", "rating:rate_safe", "wd14:m"]


def expected(probs, labels, g, c):
    """Dict semantics in float32: a later label of one name overwrites the score, not the place."""
    groups = {0: {}, 4: {}, 9: {}}
    for i, (name, category) in enumerate(labels):
        p = np.float32(probs[i])
        if category == 9 or (category == 0 and p >= np.float32(g)) or (category == 4 and p >= np.float32(c)):
            groups[category][name] = float(p)
    return [[list(x) for x in sorted(groups[k].items(), key=lambda x: -x[1])] for k in (0, 4, 9)]


def test_random_vectors_with_twin_labels_and_ties(spark):
    rng = np.random.default_rng(5)
    labels = [(f"n{i % 17}", [0, 0, 4, 9, 7][i % 5]) for i in range(60)]
    vectors = [np.round(rng.random(60), 1).astype(np.float32).tolist() for _ in range(40)]
    vectors[0][0] = float("nan")
    table_ = table(spark, LABELS, *[(i, i, n, c, 1) for i, (n, c) in enumerate(labels)])
    scores = table(spark, "file_id bigint, probs array<float>", *enumerate(vectors))
    rows = R.threshold_scores(scores, table_, 0.4, 0.7).orderBy("file_id").collect()
    for probs, row in zip(vectors, rows):
        ours = [[[t["tag"], t["conf"]] for t in row[c]] for c in ("general_tags", "character_tags", "rating_tags")]
        # Category 7 is none of ours and is ignored.
        kept = [i for i, (_, c) in enumerate(labels) if c != 7]
        assert ours == expected([probs[i] for i in kept], [labels[i] for i in kept], 0.4, 0.7)


def test_gaps_in_labels_fail(spark):
    labels = table(spark, LABELS, (0, 0, "a", 0, 1), (2, 2, "b", 0, 1))
    scores = table(spark, "file_id bigint, probs array<float>", (1, [0.9, 0.9]))
    with pytest.raises(Exception, match="label table"):
        R.threshold_scores(scores, labels).collect()


def test_prune_to_pending(spark):
    predictions = table(
        spark, "file_id bigint, category int, rank int, tag string, conf double",
        (1, 0, 0, "long_hair", 0.9), (1, 0, 1, "hat", 0.8), (1, 4, 0, "miku_x", 0.9), (1, 9, 0, "safe", 0.9), (1, 9, 1, "other", 0.1),
    )
    pending = table(spark, "file_id bigint, tag_norm string", (1, "long hair"), (1, "character:miku x"), (1, "rating:other"), (2, "hat"))
    assert got(D.prune_to_pending(predictions, pending), "tag") == [("long_hair",), ("miku_x",)]


def scorer(fail=False):
    def make():
        import numpy as np

        def predict(x):
            if fail or (x[:, 0] < 0).any():
                raise RuntimeError("cannot score")
            return x.astype(np.float32)

        return predict

    return make


def test_score_pending_skips_before_scoring_and_drops_failures(spark):
    labels = table(spark, LABELS, (0, 0, "gen0", 0, 1), (1, 1, "char1", 4, 1), (2, 2, "safe", 9, 1))
    queue = table(spark, "pos bigint, file_id bigint", (0, 1), (1, 2), (2, 3), (3, 1))
    files = spark.createDataFrame([(1,), (2,), (3,)], "file_id bigint")
    tags = stored_of(spark, (2, "s", "0", 0, "wd14:wd-vit-tagger-v3"))
    # File 2 would break its batch, but it is skipped; file 3 does break its own.
    media = table(spark, "file_id bigint, x array<float>", (1, [0.9, 0.1, 0.3]), (2, [-1.0, 0.0, 0.0]), (3, [-1.0, 0.0, 0.0]))
    rows = scoring.score_pending(
        queue, files, tags, media, labels, scorer(), ["x"], SkipRules(), batch_size=1, input_tensor_shapes=[[3]]
    )
    assert got(rows, "pos", "file_id", "skipped_inference", "tags") == [
        (0, 1, False, ["gen0", "rating:safe", "wd14:wd-vit-tagger-v3"]),
        (1, 2, True, []),
        (3, 1, False, ["gen0", "rating:safe", "wd14:wd-vit-tagger-v3"]),
    ]


def test_assemble_results(spark):
    decisions = table(spark, "pos bigint, file_id bigint, skip_reason string", (0, 1, None), (1, 2, "wd_model_marker_present"), (2, 3, None))
    inferred = table(spark, "file_id bigint, tags array<string>, stale_markers_removed int", (1, ["a"], 1))
    rows = R.assemble_results(decisions, inferred, "wd14:m")
    assert got(rows, "pos", "file_id", "skipped_inference", "tags") == [(0, 1, False, ["a"]), (1, 2, True, [])]


def test_items_of_one_file_keep_their_own_lists(spark):
    """Two queue items of a file that propose the same tag are no duplicates of each other."""
    proposed = table(spark, "item bigint, file_id bigint, pos bigint, tag string", (1, 7, 0, "a"), (2, 7, 0, "a"), (2, 7, 1, "A"), (3, 8, 0, "b"))
    stored = table(spark, "file_id bigint, service_key string, status string, tag_norm string", (8, "s", "0", "b"))
    queued = table(spark, "item bigint, file_id bigint, hash string", (1, 7, "h7"), (2, 7, "h7"), (3, 8, "h8"))
    keys = ("item", "file_id")
    own = D.tag_diff(proposed, stored, "s", keys)
    stats = D.apply_stats(queued, own, "s", keys=keys).first().asDict()
    assert (stats["items"], stats["files_written"], stats["new_tag_strings"], stats["duplicates_skipped"]) == (3, 2, 2, 2)
    together = D.apply_stats(queued.select("file_id", "hash").distinct(), D.tag_diff(proposed, stored, "s"), "s").first()
    assert together["new_tag_strings"] == 1
    actions = D.build_tag_actions(queued, own.where("is_new"), "s", keys=keys)
    assert got(actions, "hash", "add_tags") == [("h7", ["a"]), ("h7", ["a"])]


def test_a_long_list_is_one_action_unless_split(spark):
    adds = spark.range(5_000).selectExpr("1L AS file_id", "id AS pos", "concat('t', id) AS tag")
    item = table(spark, "file_id bigint, hash string", (1, "h"))
    assert [len(r["add_tags"]) for r in D.build_tag_actions(item, adds, "s").collect()] == [5_000]
    assert D.build_tag_actions(item, adds, "s", tags_per_action=1_000).count() == 5


def test_tasks_of_a_diff_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """A task sorts and groups so many rows at most, however many there are."""
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 500)
    proposed = spark.range(20_000).selectExpr("id % 3 AS file_id", "id AS pos", "concat('T_', id div 2) AS tag")
    stored = spark.range(5_000).selectExpr("id % 3 AS file_id", "'s' AS service_key", "concat('t ', id) AS tag_norm")
    diff = D.tag_diff(proposed, stored, "s")
    assert max(r["count"] for r in diff.groupBy(F.spark_partition_id()).count().collect()) < 1_000
    wanted = {(i % 3, f"t {i // 2}") for i in range(20_000)}
    known = {(i % 3, f"t {i}") for i in range(5_000)}
    assert {(r["file_id"], r["tag_norm"]): r["is_new"] for r in diff.collect()} == {k: k not in known for k in wanted}


def test_items_with_equal_lists_are_counted_by_times(spark, proposed, stored):
    items = table(spark, "file_id bigint, hash string, times bigint", (1, "h1", 3), (2, "", 2), (3, "h3", 1))
    diff = D.tag_diff(proposed, stored, "s")
    each = items.select("file_id", "hash", F.explode(F.sequence(F.lit(1), "times")))
    assert D.apply_stats(items, diff, "s", times="times").first() == D.apply_stats(each, diff, "s").first()

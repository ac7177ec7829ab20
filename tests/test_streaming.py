"""Streams over several files, one file per micro-batch, against their batch twins."""

from __future__ import annotations

import os
import shutil

import pytest
from conftest import got, table
from pyspark.sql import functions as F

from tagspark.functions.text import normalize_tag
from tagspark.operators.diff import filter_new_tags
from tagspark.operators.planning import SkipRules, skip_decisions
from tagspark.operators.sessions import log_digest
from tagspark.operators.snapshot import merge_parts, session_snapshot
from tagspark.plans.run_queries import SNAPSHOT_KEYS, event_rows
from tagspark.streaming import apply, monitors
from tagspark.streaming.folding import fold_repeats
from tagspark.streaming.tables import BATCH, latest_rows, write_batches, written

PROPOSED = "file_id bigint, pos bigint, tag string"


def staged(spark, df, folder, files=4, by=None):
    """A table as several parquet files, and the stream that reads one of them per micro-batch."""
    path = str(folder)
    parts = df.withColumn("_part", (F.hash(by) if by else F.monotonically_increasing_id()) % files)
    for i in range(files):
        parts.where(F.pmod("_part", F.lit(files)) == i).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "out"), str(tmp_path / "state"), tmp_path / "in"


@pytest.fixture(scope="module")
def stored(spark):
    rows = [(i, "s", "0", 0, f"Tag_{i % 5}") for i in range(40)]
    return table(spark, "file_id bigint, service_key string, status string, pos bigint, tag string", *rows).withColumn(
        "tag_norm", normalize_tag("tag")
    )


@pytest.fixture(scope="module")
def proposed(spark):
    return table(spark, PROPOSED, *[(i % 50, i // 50, f"tag-{(i * 7 + i // 50) % 6}") for i in range(400)])


def test_incremental_apply_equals_one_diff(spark, places, proposed, stored):
    path, state, folder = places
    stream = staged(spark, proposed, folder)
    apply.stream_apply(stream, stored, "s", path, state)
    ours = written(spark, path)
    assert ours.select(BATCH).distinct().count() > 1
    wanted = filter_new_tags(proposed, stored, "s")
    assert got(ours, "file_id", "tag_norm") == got(wanted, "file_id", "tag_norm")


def test_replayed_batches_change_nothing(spark, places, proposed, stored):
    path, state, folder = places
    stream = staged(spark, proposed, folder)
    apply.stream_apply(stream, stored, "s", path, state)
    before = got(written(spark, path), "file_id", "tag_norm")
    # The last commit was lost: the run starts again and repeats that micro-batch.
    commits = sorted((f for f in os.listdir(f"{state}/commits") if f.isdigit()), key=int)
    shutil.copytree(state, f"{state}-again", ignore=lambda d, names: [n for n in names if d.endswith("commits") and commits[-1] in n])
    apply.stream_apply(stream, stored, "s", path, f"{state}-again")
    assert got(written(spark, path), "file_id", "tag_norm") == before


def test_held_rows_wait_for_the_flush(spark, places, proposed, stored):
    path, state, folder = places
    stream = staged(spark, proposed, folder)
    apply.stream_apply(stream, stored, "s", path, state, hold=F.col("file_id") < 10)
    assert written(spark, path).where("file_id < 10").count() == 0
    apply.flush_held(stored, "s", path, 1_000)
    wanted = filter_new_tags(proposed, stored, "s")
    assert got(written(spark, path), "file_id", "tag_norm") == got(wanted, "file_id", "tag_norm")
    apply.flush_held(stored, "s", path, 1_000)
    assert written(spark, path).count() == wanted.count()


def test_each_tag_is_announced_once(spark, places, proposed):
    path, state, folder = places
    timed = proposed.withColumn("at", F.timestamp_seconds(F.col("pos")))
    apply.run_new_tags(staged(spark, timed, folder), "at", "1 hour", path, state)
    wanted = proposed.withColumn("tag_norm", normalize_tag("tag")).select("file_id", "tag_norm").distinct()
    assert got(written(spark, path), "file_id", "tag_norm") == got(wanted)


def test_a_tag_in_most_rows_is_folded_before_the_state(spark, places):
    path, state, folder = places
    rows = spark.range(8_000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(7)).alias("file_id"),
        F.lit("Hot_Tag").alias("tag"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") % 50).alias("at"),
    )
    stream = staged(spark, rows, folder)
    out = (
        apply.stream_new_tags(stream, "at", "1 hour")
        .writeStream.option("checkpointLocation", state)
        .trigger(availableNow=True)
        .format("parquet")
        .option("path", path)
        .start()
    )
    out.awaitTermination()
    assert got(spark.read.parquet(path), "file_id") == sorted([(7,), *[(i,) for i in range(0, 8_000, 10)]], key=repr)
    dropped = [s.customMetrics["numDroppedDuplicateRows"] for p in out.recentProgress for s in p.stateOperators]
    # Four micro-batches of one file: the tag in nine of ten rows reaches the state once per task.
    assert sum(dropped) < 40


@pytest.mark.parametrize("fold_rows", [1, 5, 1_000])
def test_folding_keeps_every_key_and_its_latest_time(spark, fold_rows):
    rows = [(i % 9 if i % 4 else None, i) for i in range(200)]
    df = table(spark, "file_id bigint, at bigint", *rows).repartition(3)
    folded = fold_repeats(df, ["file_id"], "at", fold_rows).groupBy("file_id").agg(F.max("at"))
    latest = {k: max(at for other, at in rows if other == k) for k, _ in rows}
    assert got(folded) == sorted(latest.items(), key=repr)
    assert fold_repeats(df.limit(0), ["file_id"], "at", fold_rows).collect() == []


def timed_events(spark, *rows):
    events = table(spark, "session_id bigint, seq bigint, at bigint, type string, k bigint", *rows)
    return event_rows(events.withColumn("ts", F.timestamp_seconds("at")))


def test_parts_of_snapshots_merge_to_the_whole(spark, places):
    path, state, folder = places
    kinds = ["queue_plan", "progress", "file", "tags_applied", "stopping", "complete"]
    # Sessions of many hours, events in no order of time, a session without id.
    made = [(None if i % 7 == 6 else i % 7, i, (i * 1_237) % 90_000, kinds[(i * 5) % 6], i * 3) for i in range(300)]
    rows = timed_events(spark, *made)
    parts = monitors.stream_snapshot_parts(staged(spark, rows, folder), SNAPSHOT_KEYS, "1 hour", "2 days")
    write_batches(parts, path, state, mode="update")
    wanted = session_snapshot(rows, SNAPSHOT_KEYS)
    assert got(merge_parts(written(spark, path), SNAPSHOT_KEYS), *wanted.columns) == got(wanted)


def test_idle_sessions_leave_the_state_and_start_anew(spark, places):
    path, state, folder = places
    hour = 3_600
    day = [(s, 1, (1 + s) * hour, "queue_plan", s) for s in range(24)]
    # The first session comes back ten hours after all others; one event is far too late.
    later = [(0, 2, 35 * hour, "progress", 5), (1, 9, 3 * hour, "stopping", 9), (2, 2, 35 * hour, "progress", 6)]
    for n, rows in enumerate([day[:8], day[8:16], day[16:], later[:1], [later[1], later[2]]]):
        timed_events(spark, *rows).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(timed_events(spark, *day[:1]).schema).parquet(str(folder))
        query = (
            monitors.stream_snapshot_parts(stream, SNAPSHOT_KEYS)
            .writeStream.outputMode("update")
            .option("checkpointLocation", state)
            .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/{BATCH}={i}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        kept = query.lastProgress.stateOperators[0].numRowsTotal
        # No more than the sessions of one step and the watermark's hour.
        assert kept <= 9, n
    assert kept == 2
    whole = {r["session_id"]: r for r in merge_parts(written(spark, path), SNAPSHOT_KEYS).collect()}
    assert len(whole) == 24
    assert (whole[0]["queue_total"], whole[0]["current"], whole[0]["last_seq"]) == (0, 5, 2)
    assert whole[1]["pending_hydrus_queue"] is None
    live = {r["session_id"]: r for r in merge_parts(written(spark, path), SNAPSHOT_KEYS, idle="4 hours").collect()}
    assert (live[0]["queue_total"], live[0]["current"], live[3]["queue_total"]) == (None, 5, 3)


def test_skip_plan_of_arriving_files(spark, places, stored):
    path, state, folder = places
    queue = table(spark, "pos bigint, file_id bigint", *[(i, i % 60) for i in range(120)])
    files = table(spark, "file_id bigint", *[(i,) for i in range(50)])
    rules = SkipRules(marker_template="tag_3")
    monitors.run_skip_plan(staged(spark, queue, folder), files, stored, rules, path, state)
    columns = ("pos", "file_id", "skip_reason", "missing")
    assert got(written(spark, path), *columns) == got(skip_decisions(queue, files, stored, rules), *columns)


def test_snapshot_and_progress_follow_the_stream(spark, places):
    path, state, folder = places
    kinds = ["queue_plan", "progress", "file", "tags_applied", "stopping", "complete"]
    events = table(
        spark, "session_id bigint, seq bigint, ts bigint, type string, k bigint", *[(i % 7, i, i, kinds[(i * 5) % 6], i * 3) for i in range(200)]
    )
    rows = event_rows(events)
    write_batches(monitors.stream_snapshot(staged(spark, rows, folder), SNAPSHOT_KEYS), path, state, mode="update")
    wanted = session_snapshot(rows, SNAPSHOT_KEYS)
    assert got(latest_rows(spark, path, ["session_id"]), *wanted.columns) == got(wanted)


def test_progress_counts(spark, places):
    path, state, folder = places
    results = spark.range(300).select(
        (F.col("id") % 4).alias("session_id"),
        F.when(F.col("id") % 3 == 0, F.lit("wd_model_marker_present")).alias("skip_reason"),
        F.lit(1).alias("stale_markers_removed"),
    )
    write_batches(monitors.stream_progress(staged(spark, results, folder)), path, state, mode="update")
    wanted = monitors.stream_progress(results)
    assert got(latest_rows(spark, path, ["session_id"]), *wanted.columns) == got(wanted)


def test_log_digest_by_window(spark, places):
    path, state, folder = places
    lines = table(
        spark, "run_id string, line string", *[("r", f"2026-01-01 00:{i % 60:02d}:00 {'ERROR' if i % 3 else 'INFO'} [r] [x] text") for i in range(240)]
    )
    stream = staged(spark, lines, folder)
    write_batches(monitors.stream_log_digest(stream, "10 minutes", "2 hours"), path, state, mode="update")
    rows = latest_rows(spark, path, ["window_start"])
    assert rows.count() == 6
    total = rows.agg(F.sum("lines"), F.sum("error_count")).first()
    whole = log_digest(lines).first()
    assert tuple(total) == (whole["lines"], whole["error_count"])


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The smallest tables as folders of part files, rows in no order of time."""
    path = str(tmp_path_factory.mktemp("tables"))
    for name in ("region", "nation", "part", "orders", "lineitem", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", ["stream_apply", "stream_progress", "stream_skip_plan", "stream_log_digest", "stream_snapshot", "stream_snapshot_live", "stream_new_tags"])
def test_streams_over_folders_equal_those_over_files(spark, folders, name, monkeypatch):
    """One file per micro-batch gives the same rows as one file with everything."""
    from tagspark.plans import catalog, stream_queries

    whole = got(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(stream_queries, "FILES_PER_TRIGGER", 1)
    parts = catalog.QUERIES[name](spark, folders)
    if name == "stream_apply":  # which spelling of a tag comes first depends on the micro-batch
        whole, parts = [(r[0], r[3]) for r in whole], parts.select("file_id", "tag_norm")
    assert got(parts) == sorted(whole, key=repr)

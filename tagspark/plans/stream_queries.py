"""Named queries that run a stream over the given tables to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagspark.operators.snapshot import merge_parts
from tagspark.plans.library import Library
from tagspark.plans.queue_queries import RULES, SERVICE
from tagspark.plans.registry import query
from tagspark.plans.run_queries import DIGEST_SQL, LIVE_SNAPSHOT_SQL, SNAPSHOT_KEYS, SNAPSHOT_SQL, event_rows
from tagspark.session import fresh_path
from tagspark.streaming import apply, monitors
from tagspark.streaming.tables import BATCH, latest_rows, read_stream, write_batches, written

FILES_PER_TRIGGER = 1_000


def arriving(lib: Library, table: str) -> DataFrame:
    """A given table as a stream of its files."""
    return read_stream(lib.spark, f"{lib.folder}/{table}.parquet", lib.table(table), FILES_PER_TRIGGER)


def _paths(lib: Library, name: str) -> tuple[str, str]:
    return fresh_path(lib.spark, name), fresh_path(lib.spark, f"{name}-state")


@query("new_tags", sql="SELECT file_id, pos, tag, tag_norm FROM new_tags")
def stream_apply(lib: Library) -> DataFrame:
    path, state = _paths(lib, "apply")
    proposals = lib.view("proposed", lineitem=arriving(lib, "lineitem"))
    apply.stream_apply(proposals, lib.file_tags, SERVICE, path, state)
    return written(lib.spark, path).drop(BATCH)


@query("file_tags", sql="SELECT DISTINCT file_id, tag_norm FROM file_tags")
def stream_new_tags(lib: Library) -> DataFrame:
    path, state = _paths(lib, "new-tags")
    lines = arriving(lib, "lineitem")
    rows = lib.view("file_tags", lineitem=lines).select("file_id", "tag", F.current_timestamp().alias("at"))
    apply.run_new_tags(rows, "at", "30 days", path, state)
    return written(lib.spark, path).drop(BATCH)


@query(
    "batch_metrics",
    sql="""SELECT session_id, count(*) AS processed, count(*) FILTER (WHERE files_in_batch % 3 = 1) AS skipped_same,
    count(*) FILTER (WHERE files_in_batch % 3 = 2) AS skipped_higher, count(*) FILTER (WHERE files_in_batch % 3 = 0) AS inferred,
    CAST(sum(predict_queue) AS BIGINT) AS stale_removed FROM batch_metrics GROUP BY session_id""",
)
def stream_progress(lib: Library) -> DataFrame:
    path, state = _paths(lib, "progress")
    rows = lib.view("batch_metrics", events=arriving(lib, "events"))
    kind = F.col("files_in_batch") % 3
    reason = F.when(kind == 1, F.lit("wd_model_marker_present")).when(
        kind == 2, F.lit("wd_skip_higher_tier_model_present")
    )
    results = rows.select("session_id", reason.alias("skip_reason"), F.col("predict_queue").alias("stale_markers_removed"))
    write_batches(monitors.stream_progress(results), path, state, mode="update")
    return latest_rows(lib.spark, path, ["session_id"])


@query("decisions", sql="SELECT pos, file_id, skip_reason, missing FROM decisions")
def stream_skip_plan(lib: Library) -> DataFrame:
    path, state = _paths(lib, "skip-plan")
    queue = lib.view("queue", orders=arriving(lib, "orders"))
    monitors.run_skip_plan(queue, lib.files, lib.file_tags, RULES, path, state)
    return written(lib.spark, path).select("pos", "file_id", "skip_reason", "missing")


@query(
    "log_lines",
    sql=f"""SELECT to_timestamp(floor(epoch(CAST(substr(line, 1, 19) AS TIMESTAMP)) / 600) * 600) AT TIME ZONE 'UTC' AS window_start,
    {DIGEST_SQL} FROM log_lines GROUP BY 1""",
)
def stream_log_digest(lib: Library) -> DataFrame:
    path, state = _paths(lib, "digest")
    lines = lib.view("log_lines", events=arriving(lib, "events"))
    write_batches(monitors.stream_log_digest(lines), path, state, mode="update")
    return latest_rows(lib.spark, path, ["window_start"])


@query("session_events", sql=SNAPSHOT_SQL)
def stream_snapshot(lib: Library) -> DataFrame:
    path, state = _paths(lib, "snapshot")
    events = event_rows(lib.view("session_events", events=arriving(lib, "events")))
    write_batches(monitors.stream_snapshot(events, SNAPSHOT_KEYS), path, state, mode="update")
    return latest_rows(lib.spark, path, ["session_id"])


# Files of a table may come in any order of time; nothing is late within the days that the events span.
EVENT_DAYS = "60 days"


@query("live_events", sql=LIVE_SNAPSHOT_SQL)
def stream_snapshot_live(lib: Library) -> DataFrame:
    """Sessions as they are after their last pause of more than 15 minutes."""
    path, state = _paths(lib, "snapshot-parts")
    events = event_rows(lib.view("session_events", events=arriving(lib, "events")))
    parts = monitors.stream_snapshot_parts(events, SNAPSHOT_KEYS, "5 minutes", EVENT_DAYS)
    write_batches(parts, path, state, mode="update")
    return merge_parts(written(lib.spark, path), SNAPSHOT_KEYS, idle="15 minutes")

"""Running views of a session: counters, snapshot, log digest, skip plan of arriving files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tagspark.functions.loglines import digest_counters, log_fields
from tagspark.operators.metrics import batch_summary
from tagspark.operators.planning import SkipRules, skip_decisions
from tagspark.operators.snapshot import session_snapshot, snapshot_parts
from tagspark.streaming.keytable import BUCKETS, BucketTable, touched
from tagspark.streaming.tables import write_batches


def stream_progress(results: DataFrame, group: Sequence[str] = ("session_id",)) -> DataFrame:
    """Counters per session over result rows (skip_reason, stale_markers_removed)."""
    return batch_summary(results, group)


def stream_snapshot(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest state per session: the same merging folds as the batch form, kept as state.

    Nothing leaves this state; a stream without end takes `stream_snapshot_parts`.
    """
    return session_snapshot(events, keys)


def stream_snapshot_parts(
    events: DataFrame, keys: Sequence[str], window: str = "1 hour", watermark: str = "1 hour"
) -> DataFrame:
    """Parts of session snapshots, one per session and time window of `ts` (a timestamp).

    A part leaves the state once the watermark has passed its window, so the state holds sessions
    of the last windows only, and idle ones are gone. Events later than that are dropped; later
    ones of an idle session make a new part. `snapshot.merge_parts` puts the written parts together,
    which gives whole snapshots however long a session is, or with `idle` those that live on.
    Events of a busy session are folded before the shuffle. Rows without a time are left out.
    """
    timed = events.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", watermark)
    parts = timed.groupBy("session_id", F.window("_at", window).alias("_span")).agg(*snapshot_parts(keys))
    return parts.withColumn("window_start", F.col("_span.start")).drop("_span")


def stream_log_digest(
    lines: DataFrame, window: str = "10 minutes", watermark: str | None = None, group: Sequence[str] = ()
) -> DataFrame:
    """Digest counters per time window of the line prefix, whatever the order of the lines.

    Without a watermark every window is kept and no line is lost, which suits a run over what there
    is. A stream without end names one: it bounds the state, and lines later than it are dropped.
    """
    timed = lines.withColumn("ts", log_fields("line")["ts"])
    timed = timed if watermark is None else timed.withWatermark("ts", watermark)
    counters = digest_counters("line")
    span = F.window("ts", window)
    return (
        timed.groupBy(span, *group)
        .agg(F.count("*").alias("lines"), *[F.count_if(hit).alias(n) for n, hit in counters.items()])
        .select(F.col("window.start").alias("window_start"), *group, "lines", *counters)
    )


def run_skip_plan(
    arriving: DataFrame,
    files: DataFrame,
    file_tags: DataFrame,
    rules: SkipRules,
    path: str,
    checkpoint: str,
    buckets: int = BUCKETS,
) -> None:
    """Skip decisions for files (pos, file_id) as they arrive, against stored tables.

    The stored tables are written once, when the stream starts, in buckets of `file_id` below
    `<path>_stored`; a micro-batch reads the buckets of its files only, however their ids lie.
    """
    tables = [
        BucketTable(table, f"{path}_stored/{name}", buckets) for name, table in (("files", files), ("file_tags", file_tags))
    ]

    def decide(batch: DataFrame, _: int) -> DataFrame:
        numbers = touched(batch, buckets)
        return skip_decisions(batch, *[table.rows(numbers) for table in tables], rules)

    write_batches(arriving, path, checkpoint, decide)

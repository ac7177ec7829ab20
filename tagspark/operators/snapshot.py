"""Latest state of a session, folded from its progress events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# ---- fixed values: which event kinds may set which keys ------------------------------------
_PROGRESS_KEYS = (
    "current",
    "total",
    "infer_total",
    "cumulative_inferred_non_skip",
    "in_marker_skip_tail",
    "progress_bar_current",
    "progress_bar_total",
    "inference_batch",
    "batch_inferred",
    "batch_skipped_inference",
    "batch_predicted",
    "batch_skipped_same_model_marker",
    "batch_skipped_higher_tier_model_marker",
    "batches_completed",
    "batches_total",
    "total_applied",
    "total_tags_written",
    "total_duplicates_skipped",
    "cumulative_skipped_same_model_marker",
    "cumulative_skipped_higher_tier_model_marker",
    "cumulative_wd_stale_markers_removed",
    "performance_tuning",
    "tuning_state",
    "calibration_phase",
)
_FINAL_KEYS = (
    "total_processed",
    "total_applied",
    "total_tags_written",
    "total_duplicates_skipped",
    "batches_completed",
    "batches_total",
    "inference_batch",
    "pending_hydrus_files",
    "cumulative_skipped_same_model_marker",
    "cumulative_skipped_higher_tier_model_marker",
    "cumulative_wd_stale_markers_removed",
)
EVENT_KEYS = {
    "progress": _PROGRESS_KEYS,
    "file": _PROGRESS_KEYS,
    "queue_plan": (
        "queue_total",
        "infer_total",
        "skip_same_marker",
        "skip_higher_tier",
        "missing_metadata",
        "infer_first",
        "metadata_chunk_used",
    ),
    "tags_applied": (
        "total_applied",
        "total_tags_written",
        "total_duplicates_skipped",
        "pending_remaining",
    ),
    "stopping": ("pending_hydrus_queue",),
    "server_shutting_down": (),
    "complete": _FINAL_KEYS,
    "stopped": _FINAL_KEYS,
}
EVENT_PHASE = {
    "progress": "tagging",
    "file": "tagging",
    "queue_plan": "tagging",
    "tags_applied": "tagging",
    "stopping": "stopping",
    "server_shutting_down": "stopping",
    "complete": "finishing",
    "stopped": "finishing",
}
STOP_SOURCE = {"stopping": "user", "server_shutting_down": "server"}


def _mapped(kind: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, value in values.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def payload_columns(events: DataFrame, keys: Sequence[str], payload: str = "payload") -> DataFrame:
    """Named payload keys (JSON text) as string columns, null where absent."""
    doc = events.withColumn("_doc", F.try_parse_json(payload))
    return doc.select(
        *[c for c in events.columns if c != payload],
        *[F.try_variant_get("_doc", f"$.{k}", "string").alias(k) for k in keys],
    )


def _values(keys: Sequence[str]) -> dict[str, Column]:
    """What an event sets, null where it may not set it."""
    kind = F.col("type")
    stopping = kind.isin(*STOP_SOURCE)
    values = {
        "phase": _mapped(kind, EVENT_PHASE),
        "stopping_source": _mapped(kind, STOP_SOURCE),
        "detail": F.when(stopping, F.coalesce("message", F.lit(""))),
    }
    for key in keys:
        allowed = [k for k, names in EVENT_KEYS.items() if key in names]
        values[key] = F.when(kind.isin(*allowed), F.col(key))
    return values


def snapshot_folds(keys: Sequence[str]) -> list[Column]:
    """Aggregates that keep, per key, the value of the last event allowed to set it.

    They merge, so a session with very many events is folded before the shuffle; and they serve
    batch and streaming alike.
    """
    seq = F.col("seq")
    folds = [F.max("seq").alias("last_seq"), F.max_by("ts", "seq").alias("updated_at")]
    return folds + [F.max_by(v, F.when(v.isNotNull(), seq)).alias(name) for name, v in _values(keys).items()]


def snapshot_parts(keys: Sequence[str]) -> list[Column]:
    """The same folds with the seq of each value beside it, so that parts of a session merge exactly."""
    values = {"updated_at": F.col("ts"), **_values(keys)}
    parts = [F.max(F.when(v.isNotNull(), F.struct("seq", v.alias("value")))).alias(n) for n, v in values.items()]
    return [F.max("seq").alias("last_seq"), *parts, F.min("ts").alias("first_at"), F.max("ts").alias("last_at")]


def merge_parts(
    parts: DataFrame, keys: Sequence[str], idle: str | None = None, group: str = "session_id"
) -> DataFrame:
    """One row per session, as `session_snapshot` has it, from parts of its time windows.

    A part may be there several times, as an update-mode stream writes it; the fullest one wins.
    With `idle` (an interval, at least as long as a window) a session that did nothing for longer
    starts anew: only what came after its last such pause counts. A null session is one session.
    """
    names = ["updated_at", *_values(keys)]
    folds = [F.max("last_seq").alias("last_seq"), *[F.max(n).alias(n) for n in names]]
    rows = parts
    if idle is not None:
        # One row per session and window, far fewer than events.
        whole = parts.groupBy(group, "window_start").agg(
            *folds, F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
        )
        along = Window.partitionBy(group).orderBy("window_start")
        pause = F.col("first_at") > F.lag("last_at").over(along) + F.expr(f"INTERVAL {idle}")
        began = whole.withColumn("_began", F.when(pause, F.col("window_start")))
        last = F.max("_began").over(Window.partitionBy(group))
        rows = began.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("window_start") >= F.col("_last")))
    merged = rows.groupBy(group).agg(*folds)
    return merged.select(group, "last_seq", *[F.col(n)["value"].alias(n) for n in names])


def session_snapshot(events: DataFrame, keys: Sequence[str], group: str = "session_id") -> DataFrame:
    """One row per session; `events` has session, seq, ts, type, message and one column per key."""
    return events.groupBy(group).agg(*snapshot_folds(keys))

"""Run analytics: batch summaries, progress, tuning report, knob search, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagspark.defaults import (
    CHUNK_ROWS,
    REJECT_OUTCOMES,
    SKIP_HIGHER_TIER,
    SKIP_SAME_MARKER,
    TUNING_WINDOW,
    WARM_UP_BATCHES,
)
from tagspark.functions.numbers import batch_files, batch_wall, progress_bar, triplet_of
from tagspark.operators.ordered import over_recent, running_totals, with_lookback, with_ordinal

SERIES_PART = 1_024


def batch_summary(results: DataFrame, keys: Sequence[str] = ("batch",)) -> DataFrame:
    """Per batch: processed, skipped by reason, inferred (the rest), stale markers removed."""
    same = F.count_if(F.col("skip_reason") == SKIP_SAME_MARKER)
    higher = F.count_if(F.col("skip_reason") == SKIP_HIGHER_TIER)
    return results.groupBy(*keys).agg(
        F.count("*").alias("processed"),
        same.alias("skipped_same"),
        higher.alias("skipped_higher"),
        (F.count("*") - same - higher).alias("inferred"),
        F.coalesce(F.sum("stale_markers_removed"), F.lit(0)).alias("stale_removed"),
    )


def progress(
    batches: DataFrame,
    batch_size: int,
    total: int | Column,
    infer_total: int | Column,
    group: Sequence[str] = (),
    extra: Sequence[str] = (),
) -> DataFrame:
    """Cumulative counters after each batch, the expected number of batches, the progress bar.

    `extra` names further per-batch counts to accumulate (written files, tags, duplicates).
    """
    total = total if isinstance(total, Column) else F.lit(total)
    infer_total = infer_total if isinstance(infer_total, Column) else F.lit(infer_total)
    counters = ["processed", "inferred", "skipped_same", "skipped_higher", "stale_removed", *extra]
    sums = {f"total_{c}": F.col(c) for c in counters}
    along = running_totals(batches, "batch", sums, group)
    left = F.greatest(F.lit(0), total - F.col("total_processed"))
    bar = progress_bar(infer_total, "total_inferred", "total_processed", total)
    return along.select(
        *group,
        "batch",
        *sums,
        (F.col("batch") + F.ceil(left / max(1, int(batch_size)))).alias("batches_total"),
        bar["current"].alias("bar_current"),
        bar["total"].alias("bar_total"),
    )


def metric_row(metrics: DataFrame) -> DataFrame:
    """Batch rows as reported: times to 4 places, memory to 2, knobs as integers."""
    shown = {
        "apply_s": F.round("apply_s", 4),
        "effective_batch": F.col("effective_batch").cast("int"),
        "download_parallel": F.col("download_parallel").cast("int"),
    }
    optional = {
        "peak_rss_mb": lambda c: F.round(c, 2),
        "intra_threads": lambda c: c.cast("int"),
        "inter_threads": lambda c: c.cast("int"),
    }
    for name, form in optional.items():
        shown[name] = form(F.col(name)) if name in metrics.columns else form(F.lit(None).cast("double"))
    return metrics.withColumns(shown)


def tuning_report(metrics: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per session: sums and means of the three timed parts, files per wall second.

    Sums are taken in decimal, so they do not depend on the order of rows.
    """
    parts = {"fetch": "fetch_s", "predict": "predict_s", "apply": "apply_s"}
    exact = {p: F.coalesce(F.col(c), F.lit(0.0)).cast("decimal(18,6)") for p, c in parts.items()}
    sums = metrics.groupBy("session_id").agg(
        F.count("*").alias("batches_recorded"),
        *[F.sum(v).cast("double").alias(f"_{p}") for p, v in exact.items()],
        F.sum(exact["fetch"] + exact["predict"] + exact["apply"]).cast("double").alias("_wall"),
    )
    joined = sessions.select("session_id", "stopped", "batches", "processed").join(sums, "session_id", "left")
    n = F.coalesce("batches_recorded", F.lit(0))
    wall = F.coalesce("_wall", F.lit(0.0))

    def total(part: str) -> Column:
        return F.coalesce(f"_{part}", F.lit(0.0))

    def mean(part: str) -> Column:
        return F.when(n > 0, F.round(total(part) / n, 4)).otherwise(F.lit(0.0))

    return joined.select(
        "session_id",
        "stopped",
        F.col("batches").alias("batches_completed"),
        n.alias("batches_recorded"),
        F.col("processed").alias("total_processed"),
        *[F.round(total(p), 4).alias(f"sum_{p}_s") for p in parts],
        F.round(wall, 4).alias("sum_wall_s"),
        *[mean(p).alias(f"avg_{p}_s") for p in parts],
        F.when(wall > 0, F.round(F.col("processed") / wall, 4)).alias("files_per_wall_s"),
    )


def tuning_series(metrics: DataFrame, part_rows: int = SERIES_PART) -> DataFrame:
    """Batch rows of each session as ordered arrays, in parts of at most `part_rows` batches."""
    fields = [c for c in metrics.columns if c not in ("session_id", "batch_index")]
    part = F.expr(f"(batch_index - 1) div {int(part_rows)}").alias("part")
    rows = F.array_sort(F.collect_list(F.struct("batch_index", *fields)))
    return metrics.groupBy("session_id", part).agg(rows.alias("batch_series"))


def rolling_history(
    metrics: DataFrame, window: int = TUNING_WINDOW, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Each batch with the last `window` batches up to it (1..128) as an array of structs.

    Batches that are missing, such as failed ones, take no place in the window.
    """
    size = max(1, min(128, int(window)))
    fields = [c for c in metrics.columns if c not in ("session_id", "batch_index")]
    numbered = with_ordinal(metrics, "batch_index", "_ordinal", ["session_id"])
    seen = with_lookback(numbered, "_ordinal", size - 1, ["session_id"], chunk_rows)
    frame = over_recent("_ordinal", size - 1, ["session_id"])
    history = F.collect_list(F.struct("batch_index", *fields)).over(frame)
    return seen.withColumn("history", history).where("_own").select("session_id", "batch_index", "history")


def label_phases(
    metrics: DataFrame,
    batch_bounds: tuple[int, int],
    parallel_bounds: tuple[int, int],
    intra_bounds: tuple[int, int] | None = None,
    warm_up: int = WARM_UP_BATCHES,
) -> DataFrame:
    """Adds phase, trial (from 1), candidate, search_done, search_total.

    Every search phase tries a fixed list of candidates, one per batch, so the phase of a batch
    follows from its number alone.
    """
    searches = [("explore_bs", triplet_of(*batch_bounds)), ("explore_dlp", triplet_of(*parallel_bounds))]
    if intra_bounds is not None:
        searches.append(("explore_intra", triplet_of(*intra_bounds)))
    start = max(1, int(warm_up))
    i = F.col("batch_index")
    phase = F.when(i <= start, F.lit("warm_up"))
    trial = F.when(i <= start, i)
    candidate = F.when(i <= start, F.lit(None).cast("int"))
    for name, values in searches:
        inside = i <= start + len(values)
        phase = phase.when(inside, F.lit(name))
        trial = trial.when(inside, i - start)
        options = F.array(*[F.lit(v) for v in values])
        candidate = candidate.when(inside, F.get(options, (i - start - 1).cast("int")))
        start += len(values)
    return metrics.select(
        "*",
        phase.otherwise(F.lit("hold")).alias("phase"),
        trial.otherwise(i - start).cast("int").alias("trial"),
        candidate.alias("candidate"),
        F.least(i, F.lit(start)).cast("int").alias("search_done"),
        F.lit(start).alias("search_total"),
    )


def best_knobs(labelled: DataFrame) -> DataFrame:
    """Per session and search phase: the candidate with the highest files per second.

    Score is 0 without wall time; the first trial wins ties.
    """
    wall = batch_wall("fetch_s", "predict_s", "apply_s")
    score = F.when(wall > 0, batch_files("files_in_batch", "predict_queue") / wall).otherwise(F.lit(0.0))
    tried = labelled.where(F.startswith("phase", F.lit("explore"))).withColumn("score", score)
    rank = F.struct("score", -F.col("trial"))
    return tried.groupBy("session_id", "phase").agg(
        F.max_by("candidate", rank).alias("best"), F.max("score").alias("score"), F.count("*").alias("trials")
    )


def tuning_eta(
    labelled: DataFrame,
    chunk_rows: int = CHUNK_ROWS,
    awaiting_approval: Column | bool = False,
    commit_segment: Column | bool = False,
) -> DataFrame:
    """Seconds until the knob search ends: mean wall of the last three batches times what is left.

    Null while waiting for approval, in the commit part, and once the search is over.
    """
    wall = batch_wall("fetch_s", "predict_s", "apply_s")
    flagged = labelled.withColumns(
        {"_wall": wall, "_waiting": F.lit(awaiting_approval), "_commit": F.lit(commit_segment)}
    )
    numbered = with_ordinal(flagged, "batch_index", "_ordinal", ["session_id"])
    seen = with_lookback(numbered, "_ordinal", 2, ["session_id"], chunk_rows)
    mean = F.avg("_wall").over(over_recent("_ordinal", 2, ["session_id"]))
    left = F.col("search_total") - F.col("search_done")
    return (
        seen.withColumn("_mean", mean)
        .where("_own")
        .select(
            "session_id",
            "batch_index",
            "phase",
            F.when(~F.col("_commit") & (F.col("_mean") != 0), F.round("_mean", 4)).alias("avg_batch_wall_s"),
            F.when(~F.col("_commit") & ~F.col("_waiting") & (left > 0), F.round(F.col("_mean") * left, 1)).alias("eta_s"),
        )
    )


def latest_two_tunings(runs: DataFrame) -> DataFrame:
    """Per model: the newest saved knobs and the ones before them.

    `runs` holds model, saved_at, run_id and knob columns. Only two rows per model leave each
    task: Spark applies the rank limit before the shuffle.
    """
    knobs = [c for c in runs.columns if c not in ("model", "saved_at", "run_id")]
    newest = Window.partitionBy("model").orderBy(F.desc("saved_at"), F.desc("run_id"))
    top = runs.withColumn("_n", F.row_number().over(newest)).where("_n <= 2")

    def pick(n: int, prefix: str) -> list[Column]:
        return [F.max(F.when(F.col("_n") == n, F.col(c))).alias(f"{prefix}_{c}") for c in ("saved_at", *knobs)]

    return top.groupBy("model").agg(*pick(1, "last"), *pick(2, "previous"))


def process_totals(sessions: DataFrame) -> DataFrame:
    """One row: tagging sessions, rejected requests, files and batches (never below zero)."""
    rejected = F.coalesce(F.col("outcome").isin(*REJECT_OUTCOMES), F.lit(False))

    def floored(column: str) -> Column:
        return F.coalesce(F.sum(F.when(~rejected, F.greatest(F.lit(0), F.col(column)))), F.lit(0))

    return sessions.agg(
        F.count_if(~rejected).alias("tagging_sessions"),
        F.count_if(rejected).alias("validation_rejects"),
        floored("processed").alias("files_processed"),
        floored("batches").alias("outer_batches"),
    )


def session_metrics(batches: DataFrame, group: Sequence[str], writes: DataFrame, walls: DataFrame) -> DataFrame:
    """Per session: totals of its batches and writes, and rates over its wall time.

    `writes` holds duplicates_skipped and new_tag_strings per session, `walls` wall_s.
    """
    keys = list(group)
    totals = batches.groupBy(*keys).agg(
        F.sum("skipped_same").alias("skipped_same"),
        F.sum("skipped_higher").alias("skipped_higher"),
        F.sum("stale_removed").alias("stale_removed"),
        F.sum("processed").alias("files_processed"),
    )
    joined = totals.join(writes, keys, "left").join(walls, keys, "left")
    inferred = F.greatest(F.lit(0), F.col("files_processed") - F.col("skipped_same") - F.col("skipped_higher"))
    tags, wall = F.coalesce("new_tag_strings", F.lit(0)), F.col("wall_s")

    def rate(count: Column) -> Column:
        return F.when(wall > 0, count / wall).otherwise(F.lit(0.0))

    return joined.select(
        *keys,
        "skipped_same",
        "skipped_higher",
        F.coalesce("duplicates_skipped", F.lit(0)).alias("duplicates_skipped"),
        "stale_removed",
        "files_processed",
        tags.alias("tags_applied"),
        inferred.alias("inferred_non_skip"),
        F.round(rate(inferred), 4).alias("inferred_per_s"),
        F.round(rate(tags), 4).alias("tags_per_s"),
    )


def verify_summary(checks: DataFrame) -> DataFrame:
    """One row: number of checked models and how many are sound."""
    return checks.agg(F.count("*").alias("count"), F.count_if("ok").alias("ok_count"))

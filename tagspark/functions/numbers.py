"""Clamped settings, rates and progress values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagspark.defaults import REJECT_OUTCOMES
from tagspark.functions.text import _col

# Fixed values: (low, high, value used when the input is missing or no number).
SETTING_BOUNDS = {
    "score_batch": (1, 256, 8),
    "metadata_chunk": (32, 2048, 512),
    "download_parallel": (1, 32, 8),
    "apply_every": (0, 256, 8),
    "apply_http_batch": (1, 512, 100),
    "skip_tail_batch": (32, 2048, 512),
    "tuning_window": (1, 128, 32),
    "intra_threads": (1, 64, 8),
    "inter_threads": (1, 16, 1),
}


def clamp(value: Column | str, low: float, high: float, default: float | None) -> Column:
    """Number within bounds; a null or unreadable input takes the default."""
    kind = "double" if isinstance(low, float) else "bigint"
    number = _col(value).try_cast(kind)
    bounded = F.least(F.greatest(number, F.lit(low)), F.lit(high))
    fallback = F.lit(None).cast(kind) if default is None else F.lit(default).cast(kind)
    return F.when(number.isNull(), fallback).otherwise(bounded)


def clamp_setting(value: Column | str, setting: str) -> Column:
    low, high, default = SETTING_BOUNDS[setting]
    return clamp(value, low, high, default)


def clamp_fraction(value: Column | str) -> Column:
    """Learning fraction: 0.01..0.5, default 0.1; NaN ends at the upper bound."""
    return clamp(value, 0.01, 0.5, 0.1)


def clamp_timeout(value: Column | str) -> Column:
    """Seconds 30..3600; null (wait for ever) when missing, unreadable or not positive."""
    seconds = _col(value).try_cast("double")
    return F.when(seconds > 0, clamp(value, 30.0, 3600.0, None))


def fraction_of(raw: object) -> float:
    """`clamp_fraction` for a job parameter."""
    try:
        number = float(raw)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 0.1
    return 0.5 if number != number else max(0.01, min(0.5, number))


def triplet(low: Column | str, high: Column | str) -> Column:
    """Sorted distinct [low, middle, high]; swapped bounds are put right."""
    a, b = F.least(_col(low), _col(high)), F.greatest(_col(low), _col(high))
    middle = F.floor((a + b) / 2).cast("int")
    return F.array_sort(F.array_distinct(F.array(a.cast("int"), middle, b.cast("int"))))


def triplet_of(low: int, high: int) -> list[int]:
    return sorted({low, (low + high) // 2, high})


def outcome_status(outcome: Column | str, stopped: Column | str) -> Column:
    return (
        F.when(_col(outcome) == "error", F.lit("error"))
        .when(_col(outcome).isin(*REJECT_OUTCOMES), F.lit("skipped"))
        .when(_col(stopped), F.lit("stopped"))
        .otherwise(F.lit("complete"))
    )


def throughput(elapsed_s: Column | str, files: Column | str, tags: Column | str) -> Column:
    """struct(files_per_s, tags_per_s); both null under 0.35 s or when a count is unusable."""
    elapsed, files, tags = _col(elapsed_s), _col(files), _col(tags)
    usable = (elapsed >= 0.35) & (files >= 0) & (tags >= 0)
    return F.struct(
        F.when(usable, files / elapsed).alias("files_per_s"),
        F.when(usable, tags / elapsed).alias("tags_per_s"),
    )


def progress_bar(
    infer_total: Column | str, inferred: Column | str, done: Column | str, total: Column | str
) -> Column:
    """struct(current, total): scored files first, then the skip tail with its own denominator."""
    infer_total, inferred, done, total = map(_col, (infer_total, inferred, done, total))
    scoring = inferred < infer_total
    current = (
        F.when(infer_total <= 0, done)
        .when(scoring, inferred)
        .otherwise(F.greatest(F.lit(0), done - infer_total))
    )
    out_of = (
        F.when(infer_total <= 0, total)
        .when(scoring, infer_total)
        .otherwise(F.greatest(F.lit(1), total - infer_total))
    )
    return F.struct(current.cast("bigint").alias("current"), out_of.cast("bigint").alias("total"))


def batch_wall(fetch: Column | str, predict: Column | str, apply: Column | str) -> Column:
    """Wall seconds of one batch; missing parts count as zero and decoding is not part of it."""
    zero = F.lit(0.0)
    return F.coalesce(_col(fetch), zero) + F.coalesce(_col(predict), zero) + F.coalesce(_col(apply), zero)


def batch_files(files_in_batch: Column | str, predict_queue: Column | str) -> Column:
    """Files of one batch; zero counts as missing, so the predict queue steps in."""
    return F.coalesce(
        F.nullif(_col(files_in_batch), F.lit(0)), F.nullif(_col(predict_queue), F.lit(0)), F.lit(0)
    )

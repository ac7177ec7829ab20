"""Queue calibration: learning part and commit part, batch numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagspark.defaults import (
    LEARNING_FRACTION,
    LEARNING_MIN_FILES,
    SCORE_BATCH,
    SKIP_TAIL_BATCH,
)
from tagspark.functions.numbers import fraction_of
from tagspark.operators.ordered import running_totals, with_ordinal
from tagspark.operators.skew import lookup_join


def _within(n: Column, wanted: Column) -> Column:
    """Learning size: at least the minimum, and one file is left to commit when there are two."""
    size = F.greatest(F.lit(1), F.least(F.greatest(F.lit(LEARNING_MIN_FILES), wanted), n - 1))
    return F.when(n <= 1, n).otherwise(size)


def _by_count(n: Column, fraction: float) -> Column:
    return _within(n, F.ceil(F.lit(fraction) * n))


def learning_size(queue: DataFrame, fraction: object = LEARNING_FRACTION, cap: int | None = None) -> DataFrame:
    """One row: n, split_index (uncapped) and learning_count (capped)."""
    counted = queue.agg(F.count("*").alias("n"))
    return counted.withColumn("split_index", _by_count(F.col("n"), fraction_of(fraction))).withColumn(
        "learning_count", _capped(cap)
    )


def _capped(cap: int | None) -> Column:
    """A cap is for callers that hold the learning part in memory; there is none unless one is given."""
    return F.col("split_index") if cap is None else F.least("split_index", F.lit(cap))


def _segments(ordered: DataFrame, size: Column) -> DataFrame:
    return ordered.withColumn(
        "segment", F.when(F.col("ordinal") < size, F.lit("learning")).otherwise(F.lit("commit"))
    )


def learning_split(
    queue: DataFrame,
    fraction: object = LEARNING_FRACTION,
    cap: int | None = None,
) -> DataFrame:
    """Queue rows with ordinal and segment. What the cap cuts off leads the commit part."""
    size = learning_size(queue, fraction, cap).select("learning_count").scalar()
    return _segments(with_ordinal(queue, "pos"), size)


def sized_queue(queue: DataFrame, files: DataFrame) -> DataFrame:
    return lookup_join(queue, files.select("file_id", F.col("size").cast("bigint").alias("size")), "file_id", "pos")


def learning_size_bytes(
    queue: DataFrame,
    files: DataFrame | None,
    fraction: object = LEARNING_FRACTION,
    cap: int | None = None,
) -> DataFrame:
    """One row on the split by cumulative size, with the reason when it falls back to counting."""
    share = fraction_of(fraction)
    if files is None:
        return learning_size(queue, fraction, cap).select(
            "n",
            F.lit(None).cast("bigint").alias("total_bytes"),
            F.lit(None).cast("bigint").alias("target_bytes"),
            F.when(F.col("n") > 0, F.lit("no_metadata")).alias("fallback"),
            "split_index",
            "learning_count",
        )
    return _size_info(_along_sizes(queue, files), share, cap)


def _along_sizes(queue: DataFrame, files: DataFrame) -> DataFrame:
    """Queue rows with their size, and rows and bytes up to each; dealt into ranges and written once."""
    sums = {"_seen": F.lit(1).cast("bigint"), "_bytes": F.col("size")}
    return running_totals(sized_queue(queue, files), "pos", sums)


def _size_info(along: DataFrame, share: float, cap: int | None) -> DataFrame:
    totals = along.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("size").isNull()).alias("unsized"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
    ).select(
        "*",
        F.when(F.col("n") == 0, F.lit(None))
        .when(F.col("unsized") > 0, F.lit("missing_size"))
        .when(F.col("total_bytes") <= 0, F.lit("zero_total_bytes"))
        .alias("fallback"),
        F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("total_bytes"))).alias("target_bytes"),
    )
    target = totals.select("target_bytes").scalar()
    reached = along.agg(F.min(F.when(F.col("_bytes") >= target, F.col("_seen"))).alias("k"))
    by_bytes = _within(F.col("n"), F.coalesce(reached.scalar(), F.col("n")))
    counting = F.col("fallback").isNotNull()
    return totals.select(
        "n",
        F.when(F.coalesce(F.col("fallback") != "missing_size", F.lit(True)), F.col("total_bytes")).alias("total_bytes"),
        F.when(~counting, F.col("target_bytes")).alias("target_bytes"),
        "fallback",
        F.when(counting, _by_count(F.col("n"), share)).otherwise(by_bytes).alias("split_index"),
    ).withColumn("learning_count", _capped(cap))


def learning_split_bytes(
    queue: DataFrame,
    files: DataFrame | None,
    fraction: object = LEARNING_FRACTION,
    cap: int | None = None,
) -> DataFrame:
    """Queue rows with ordinal and segment; the learning part ends where the size share is reached.

    The totals, the place where the share is reached and the ordinals all come from one table of
    ranges.
    """
    if files is None:
        return learning_split(queue, fraction, cap)
    along = _along_sizes(queue, files)
    size = _size_info(along, fraction_of(fraction), cap).select("learning_count").scalar()
    rows = along.withColumn("ordinal", F.col("_seen") - 1)
    return _segments(rows.select(*queue.columns, "ordinal"), size)


def _as_col(value: int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(int(value)).cast("bigint")


def assign_batches(
    ordered: DataFrame,
    batch_size: int = SCORE_BATCH,
    infer_cut: int | Column = 0,
    split_at: int | Column = 0,
    tail_cap: int = SKIP_TAIL_BATCH,
    tag_all: bool = False,
) -> DataFrame:
    """Adds the batch number (from 1) to rows that carry a run-order `ordinal`.

    Batches have a fixed size and end early at `split_at`. With `tag_all`, the first batch that
    starts at or after `infer_cut` opens the skip tail, whose batches take the larger of the batch
    size and the tail cap. The counts may be scalar subqueries; no row looks at another one.
    """
    size = int(batch_size)
    tail = max(size, max(32, min(2048, int(tail_cap))))
    cut, split, o = _as_col(infer_cut), _as_col(split_at), F.col("ordinal")

    def starts_before(position: Column) -> Column:
        """Number of normal batches that start before a position."""
        return F.when(position <= split, F.ceil(position / size)).otherwise(
            F.ceil(split / size) + F.ceil((position - split) / size)
        )

    def number(position: Column) -> Column:
        """Zero-based normal batch that holds a position."""
        return F.when(position < split, F.floor(position / size)).otherwise(
            F.ceil(split / size) + F.floor((position - split) / size)
        )

    normal = number(o)
    if not tag_all:
        return ordered.withColumn("batch", (normal + 1).cast("bigint"))
    # First normal batch start at or after the cut.
    in_learning = F.least(F.ceil(cut / size) * size, split)
    opening = F.when(cut <= split, in_learning).otherwise(split + F.ceil((cut - split) / size) * size)
    batches_before = starts_before(opening)
    in_tail = (cut > 0) & (o >= opening)
    batch = F.when(in_tail, batches_before + F.floor((o - opening) / tail)).otherwise(normal)
    return ordered.withColumn("batch", (batch + 1).cast("bigint"))

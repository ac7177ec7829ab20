"""Ordinals and running totals over long ordered groups, without one task per group.

A plain window puts each group into one task, and an unpartitioned one puts everything there.
Here rows are dealt into ranges of (group, order) that hold about the same number of rows however
the values lie. A window counts inside a range, and what came before it is added from a table with
one row per (group, range). That table is the only thing a window sees of a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagspark.defaults import CHUNK_ROWS
from tagspark.session import cut_lineage

_CHUNK = "_chunk"
RANGE = "_range"


def range_buckets(df: DataFrame, keys: Sequence[str], name: str = "ranges") -> DataFrame:
    """Rows dealt into ranges of `keys` and written once, with the number of their range.

    Ranges hold about the same number of rows however the values lie; equal keys share a range.
    The table is written because range bounds are sampled: every reader must see the same ones.
    """
    dealt = df.repartitionByRange(*keys)
    return cut_lineage(dealt.withColumn(RANGE, F.spark_partition_id()), name)


def range_totals(
    df: DataFrame, order: Sequence[str], sums: Mapping[str, Column], group: Sequence[str] = ()
) -> DataFrame:
    """Inclusive running sums per group along `order`; (group, order) must be unique.

    A window works inside one range at a time. What came before a range is added from a table
    with one row per (group, range), which is all that a window sees of a whole group.
    """
    values = {name: F.coalesce(value, F.lit(0)) for name, value in sums.items()}
    keys = [*group, RANGE]
    rows = range_buckets(df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()]), [*group, *order])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_in_{n}") for n in values])
    whole = rows.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_all_{n}") for n in values])
    earlier = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.sum(f"_all_{n}").over(earlier).alias(f"_before_{n}") for n in values],
    )
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    joined = local.join(before, same, "left")
    totals = [(F.col(f"_in_{n}") + F.coalesce(f"_before_{n}", F.lit(0))).alias(n) for n in values]
    return joined.select(*df.columns, *totals)


def chunk_of(order: str, chunk_rows: int = CHUNK_ROWS) -> Column:
    return F.expr(f"`{order}` div {int(chunk_rows)}")


def running_totals(
    df: DataFrame, order: str, sums: Mapping[str, Column], group: Sequence[str] = (), major: Sequence[str] = ()
) -> DataFrame:
    """Inclusive running sums per group along (`major`, `order`).

    `order` is unique within (group, major); `major` columns are sorted first. Every input row is
    kept. A running count is the sum of a literal 1.
    """
    return range_totals(df, [*major, order], sums, group)


def with_ordinal(
    df: DataFrame, order: str, name: str = "ordinal", group: Sequence[str] = (), major: Sequence[str] = ()
) -> DataFrame:
    """Zero-based dense position of every row along (`major`, `order`) within its group."""
    counted = running_totals(df, order, {name: F.lit(1).cast("bigint")}, group, major)
    return counted.withColumn(name, F.col(name) - 1)


def with_lookback(
    df: DataFrame, order: str, rows: int, group: Sequence[str], chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Copy the last `rows` rows before a chunk into it, so that short frames see them.

    `order` is an ordinal without gaps inside its group, as `with_ordinal` gives it.

    Adds `_chunk` and `_own`; after the frame is computed per (group, `_chunk`) keep the rows with
    `_own`. At most rows / chunk_rows of the data is copied.
    """
    size = max(int(chunk_rows), rows + 1)
    chunk = chunk_of(order, size)
    near_end = F.col(order) % size >= size - rows
    copies = F.when(near_end, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    return df.withColumn("_own_chunk", chunk).select(
        "*", F.explode(copies).alias(_CHUNK)
    ).withColumn("_own", F.col(_CHUNK) == F.col("_own_chunk")).drop("_own_chunk")


def over_recent(order: str, rows: int, group: Sequence[str]):
    """The window that goes with `with_lookback`: this row and the `rows` rows before it."""
    return Window.partitionBy(*group, _CHUNK).orderBy(order).rowsBetween(-rows, 0)


def neighbours_of(df: DataFrame, order: str, value: str) -> DataFrame:
    """Adds `previous` and `next` values along `order`, null at both ends of the whole table."""
    rows = range_buckets(df, [order], "neighbours")
    inside = Window.partitionBy(RANGE).orderBy(order)
    local = rows.select(
        "*",
        F.lag(value).over(inside).alias("_previous"),
        F.lead(value).over(inside).alias("_next"),
    )
    ends = rows.groupBy(RANGE).agg(
        F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last")
    )
    along = Window.orderBy(RANGE)
    edges = ends.select(
        RANGE,
        F.lag("_last").over(along).alias("_before"),
        F.lead("_first").over(along).alias("_after"),
    )
    return local.join(edges, RANGE, "left").select(
        *df.columns,
        F.coalesce("_previous", "_before").alias("previous"),
        F.coalesce("_next", "_after").alias("next"),
    )

"""Folding repeats inside a task, before a streaming operator shuffles rows to its state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

FOLD_ROWS = 200_000


def _fold(batches: Iterator[pa.RecordBatch], keys: list[str], at: str, fold_rows: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def folded() -> pa.Table:
        grouped = pa.Table.from_batches(held).group_by(keys).aggregate([(at, "max")])
        return grouped.rename_columns([*keys, at])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= fold_rows:
            table = folded()
            held, size = table.combine_chunks().to_batches(), table.num_rows
            # Keys that hardly repeat are sent on; repeats go on being folded.
            if size > fold_rows // 2:
                yield from held
                held, size = [], 0
    if size:
        yield from folded().combine_chunks().to_batches()


def fold_repeats(rows: DataFrame, keys: Sequence[str], at: str, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(keys, `at`): repeats of a key within a task become one row with the latest time.

    Streaming plans have no partial aggregation in front of a deduplication, so all copies of a hot
    key would meet in one task. Folded in Arrow batches, a key sends few rows per task. A task holds
    at most about `fold_rows` rows. Null keys are a key of their own; a key whose times are all null
    keeps a null. An operator that reads times as a watermark names it behind this step.
    """
    columns = [*keys, at]
    picked = rows.select(*columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _fold(batches, columns[:-1], at, fold_rows):
            yield batch.select(columns)

    return picked.mapInArrow(fold, picked.schema)

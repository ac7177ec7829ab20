"""Reading given tables as streams, and tables that hold one folder per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

BATCH = "batch_id"


def read_stream(
    spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int | None = None
) -> DataFrame:
    """A stored table, one file or a folder of part files, as a stream of its files.

    A stream takes a plain path for a folder; as a pattern that only matches itself it may be either.
    """
    parent, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(like.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{parent}/[{name[0]}]{name[1:]}")


def write_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    transform: Callable[[DataFrame, int], DataFrame] | None = None,
    mode: str = "append",
) -> None:
    """Run the stream over all that is available; each micro-batch overwrites its own folder.

    A micro-batch that is replayed after a failure replaces what it wrote before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch, batch_id) if transform else batch
        rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def written(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Rows of all finished micro-batches, or of those before one; None when there are none."""
    try:
        rows = spark.read.option("basePath", path).parquet(path)
    except AnalysisException as error:
        # Before the first micro-batch there is no folder; any other error is one.
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows if before is None else rows.where(F.col(BATCH) < before)


def latest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row per key of a table written in update mode."""
    rows = written(spark, path)
    if rows is None:
        raise ValueError(f"nothing was written to {path}")
    others = [c for c in rows.columns if c not in (*keys, BATCH)]
    newest = F.max_by(F.struct(*others), BATCH).alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


"""Incremental apply: new tags of each micro-batch, exactly once in effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagspark.functions.text import normalize_tag
from tagspark.operators.diff import filter_new_tags
from tagspark.streaming.folding import FOLD_ROWS, fold_repeats
from tagspark.streaming.keytable import BUCKETS, FANOUT, BucketTable, KeyLog, touched
from tagspark.streaming.tables import BATCH, write_batches, written


def _known(stored: DataFrame, path: str, before: int | None, service_key: str) -> DataFrame:
    """Stored tags plus the ones written by earlier micro-batches."""
    keys = stored.select("file_id", "service_key", "tag_norm")
    earlier = written(stored.sparkSession, path, before)
    if earlier is None:
        return keys
    mine = earlier.select("file_id", F.lit(service_key).alias("service_key"), "tag_norm")
    return keys.unionByName(mine)


def stream_apply(
    proposals: DataFrame,
    stored: DataFrame,
    service_key: str,
    path: str,
    checkpoint: str,
    hold: Column | None = None,
    buckets: int = BUCKETS,
    fanout: int = FANOUT,
) -> None:
    """Write (file_id, pos, tag, tag_norm) of tags that are new, one folder per micro-batch.

    Each micro-batch is compared with the stored tags and with what earlier ones wrote. Its size
    (the apply stride) is set on the source. Rows for which `hold` is true are kept aside under
    `<path>_held` until `flush_held`.

    Stored tags are read once, when the stream starts, into `<path>_stored` by buckets of their
    file; what batches write is added to `<path>_keys`. A batch reads the buckets of its files only.
    """
    spark = stored.sparkSession
    mine = stored.where(F.col("service_key").eqNullSafe(F.lit(service_key)))
    base = BucketTable(mine.select("file_id", "service_key", "tag_norm"), f"{path}_stored", buckets)
    log = KeyLog(spark, f"{path}_keys", buckets, fanout)
    held_rows = F.lit(False) if hold is None else F.coalesce(hold, F.lit(False))

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if hold is not None:
                held = batch.where(held_rows)
                held.write.mode("overwrite").parquet(f"{path}_held/{BATCH}={batch_id}")
            rows = batch.where(~held_rows)
            log.compact(batch_id)
            numbers = touched(rows, buckets)
            known = base.rows(numbers).unionByName(log.known(batch_id, numbers))
            out = f"{path}/{BATCH}={batch_id}"
            filter_new_tags(rows, known, service_key).write.mode("overwrite").parquet(out)
            fresh = spark.read.schema("file_id bigint, tag_norm string").parquet(out)
            log.add(fresh.withColumn("service_key", F.lit(service_key)), batch_id)
        finally:
            batch.unpersist()

    query = (
        proposals.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(apply_batch)
        .start()
    )
    query.awaitTermination()


def flush_held(stored: DataFrame, service_key: str, path: str, flush_id: int) -> DataFrame | None:
    """Apply the rows kept aside once the commit pass is over; a stopped run does not call this.

    `flush_id` is the folder number to write, above every micro-batch number.
    """
    spark = stored.sparkSession
    held = written(spark, f"{path}_held")
    if held is None:
        return None
    known = _known(stored, path, flush_id, service_key)
    fresh = filter_new_tags(held.drop(BATCH), known, service_key)
    fresh.write.mode("overwrite").parquet(f"{path}/{BATCH}={flush_id}")
    return spark.read.parquet(f"{path}/{BATCH}={flush_id}")


def stream_new_tags(
    proposals: DataFrame, event_time: str, delay: str = "10 minutes", fold_rows: int = FOLD_ROWS
) -> DataFrame:
    """(file_id, tag_norm, event time): each (file_id, tag_norm) at most once within the watermark delay.

    Repeats are folded in their task first, so that a tag in most rows of a micro-batch sends a few
    rows to the task that keeps its state. The latest of folded times stands for them: it is late
    only if all of them are, and the watermark moves as it would have.
    """
    keyed = proposals.withColumn("tag_norm", normalize_tag("tag"))
    once = fold_repeats(keyed, ["file_id", "tag_norm"], event_time, fold_rows).withWatermark(event_time, delay)
    return once.dropDuplicatesWithinWatermark(["file_id", "tag_norm"])


def run_new_tags(proposals: DataFrame, event_time: str, delay: str, path: str, checkpoint: str) -> None:
    unique = stream_new_tags(proposals, event_time, delay).select("file_id", "tag_norm")
    write_batches(unique, path, checkpoint)

"""Run logs as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagspark.functions.loglines import LINE_BREAKS
from tagspark.operators.ordered import running_totals


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, line_no, line, modified_at). Undecodable bytes become replacement characters.

    Files are read in splittable blocks, whatever their size, and lines are numbered from 0 along
    each file. A line ends at any break that Python's `splitlines` knows, and a break at the end of
    a file starts no further line. A byte order mark is no part of the first line.
    """
    found = F.col("_metadata")
    text = F.make_valid_utf8("value")
    cr = F.endswith(text, F.lit("\r"))
    # Blocks are cut at newlines; a carriage return before one belongs to the same break.
    body = F.when(cr, F.expr("left(make_valid_utf8(value), char_length(make_valid_utf8(value)) - 1)")).otherwise(text)
    rows = spark.read.option("lineSep", "\n").text(path).select(
        found["file_path"].alias("file"),
        F.regexp_replace(found["file_name"], r"\.log$", "").alias("run_id"),
        found["file_modification_time"].alias("modified_at"),
        found["file_size"].alias("file_size"),
        found["file_block_start"].alias("block"),
        # A row's id rises inside a block; the block start gives the place of the block in its file.
        F.monotonically_increasing_id().alias("row"),
        (F.octet_length("value") + 1).cast("bigint").alias("bytes"),
        cr.alias("cr"),
        F.split(body, LINE_BREAKS, -1).alias("lines"),
    )
    sums = {"upto": F.size("lines").cast("bigint"), "bytes_upto": F.col("bytes")}
    numbered = running_totals(rows, "row", sums, group=["file"], major=["block"])
    # Only the last row may lack its newline, and then the sum is one byte more than the file has.
    open_end = (F.col("bytes_upto") == F.col("file_size") + 1) & ~F.col("cr") & (F.size("lines") > 1)
    ended = open_end & (F.element_at("lines", -1) == "")
    kept = F.when(ended, F.slice("lines", F.lit(1), F.size("lines") - 1)).otherwise(F.col("lines"))
    first = (F.col("upto") - F.size("lines")).alias("first")
    return numbered.select("run_id", "modified_at", first, F.posexplode(kept).alias("i", "line")).select(
        "run_id", (F.col("first") + F.col("i")).alias("line_no"), "line", "modified_at"
    )

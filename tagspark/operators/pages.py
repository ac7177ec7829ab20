"""Pages of an ordered table by rank: one write in ranges, then every page reads only its ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tagspark.defaults import PAGE_SIZE
from tagspark.session import fresh_path

RANGE_ROWS = 500_000
POSITION = "position"


class PageIndex:
    """An ordered table as sorted files, and how many rows lie before each file.

    `order` names columns (or sorted columns). Ties are put apart by a hash of their row, so rows of
    one order value may be many; only rows equal in all columns share a range. Pages do not move
    between reads. Nulls stand where Spark sorts them. A page reads the files that hold it, however
    deep it lies, and places come from the row numbers of a file, so nothing is sorted to find it.
    """

    def __init__(
        self, df: DataFrame, order: Sequence[str | Column], path: str | None = None, range_rows: int = RANGE_ROWS
    ) -> None:
        self.spark: SparkSession = df.sparkSession
        self.path = path or fresh_path(self.spark, "pages")
        self.schema, self.columns = df.schema, df.columns
        ranges = max(1, -(-df.count() // range_rows))
        maps = {f.name for f in df.schema if "map<" in f.dataType.simpleString() or f.dataType.simpleString() == "variant"}
        by = [*order, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c not in maps])]
        sorted_rows = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
        sorted_rows.write.parquet(f"{self.path}/rows")
        self._write_starts()

    def _write_starts(self) -> None:
        # Spark names files by the number of their task and then of the file within it.
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        sizes = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))
        task, part = [F.regexp_extract("file", p, 1).cast("bigint") for p in (r"^part-(\d+)-", r"-c(\d+)\.")]
        earlier = Window.orderBy(task, part)
        before = F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
        starts = sizes.select("file", "n", F.coalesce(before, F.lit(0)).alias("start"))
        starts.write.parquet(f"{self.path}/starts")

    @property
    def starts(self) -> DataFrame:
        """One row per file: file, n rows, start (rows before it)."""
        return self.spark.read.schema("file string, n bigint, start bigint").parquet(f"{self.path}/starts")

    def rows(self, first: int, end: int) -> DataFrame:
        """Rows from one place up to before another, in order, with their `position` from 0."""
        holding = self.starts.where((F.col("start") < end) & (F.col("start") + F.col("n") > first))
        found = {row["file"]: row["start"] for row in holding.collect()}
        if not found:
            return self.spark.createDataFrame([], self.schema).withColumn(POSITION, F.lit(0).cast("bigint"))
        read = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{file}" for file in found])
        start = F.element_at(F.create_map(*[F.lit(x) for pair in found.items() for x in pair]), F.col("_metadata.file_name"))
        placed = read.withColumn(POSITION, start + F.col("_metadata.row_index"))
        return placed.where((F.col(POSITION) >= first) & (F.col(POSITION) < end)).orderBy(POSITION)

    def page(self, number: int, size: int = PAGE_SIZE) -> DataFrame:
        """One page (from 0), in order; empty beyond the last one."""
        return self.rows(number * size, (number + 1) * size).select(*[F.col(f"`{c}`") for c in self.columns])

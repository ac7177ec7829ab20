"""Stored rows in hash buckets of `file_id`, and a log of keys that micro-batches add to them.

A micro-batch touches some buckets and reads only those. Keys that it adds are one run of its own.
Runs are merged like digits of a number: after every `fanout` runs of a level there is one run of the
next level instead, so a batch reads a number of runs that grows with the logarithm of the batches
before it, and a key is written anew once per level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKET = "_bucket"
BUCKETS = 64
FANOUT = 4
KEY_SCHEMA = "file_id bigint, service_key string, tag_norm string"


def bucket_of(column: str = "file_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def touched(batch: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Numbers of the buckets that a micro-batch needs, at most `buckets` of them."""
    return [row[0] for row in batch.select(bucket_of(buckets=buckets)).distinct().collect()]


def write_buckets(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """One folder per bucket, sorted by `file_id`; what stood there is replaced.

    A bucket is spread over several tasks by id, so that a large one is several files.
    """
    marked = rows.withColumn(BUCKET, bucket_of(buckets=buckets))
    dealt = marked.repartitionByRange(BUCKET, "file_id").sortWithinPartitions(BUCKET, "file_id")
    dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, paths: Sequence[str], base: str, schema: str, numbers: Sequence[int]) -> DataFrame:
    """Rows of some buckets; other folders are not read."""
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    if not paths or not numbers:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(f"{schema}, run string, {BUCKET} int").option("basePath", base)
    return reader.parquet(*paths).where(F.col(BUCKET).isin(list(numbers))).select(*columns)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


class BucketTable:
    """A table written once in buckets, for lookups by micro-batches."""

    def __init__(self, rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = rows.sparkSession, path, buckets
        self.schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
        self.columns = rows.columns
        write_buckets(rows, path, buckets)

    def rows(self, numbers: Sequence[int]) -> DataFrame:
        """Rows of some buckets; the folders of others are not read."""
        found = self.spark.read.option("basePath", self.path).schema(f"{self.schema}, {BUCKET} int").parquet(self.path)
        return found.where(F.col(BUCKET).isin(list(numbers))).select(*self.columns)


class KeyLog:
    """Keys (file_id, service_key, tag_norm) that micro-batches added, in runs below one folder.

    A run holds the keys of `fanout ** level` batches one after the other; one without `_SUCCESS`
    is not there. Only the last micro-batch is ever replayed, and it reads what it read at first:
    the batches before it, whatever runs they are in by now.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.buckets, self.fanout = spark, path.rstrip("/"), buckets, fanout

    def _run(self, level: int, index: int) -> str:
        return f"{self.path}/run={level}-{index}"

    def _present(self) -> set[tuple[int, int]]:
        files, place = _files(self.spark, self.path)
        if not files.exists(place):
            return set()
        names = [status.getPath().getName() for status in files.listStatus(place)]
        runs = [n for n in names if n.startswith("run=") and files.exists(_files(self.spark, f"{self.path}/{n}/_SUCCESS")[1])]
        return {tuple(map(int, n.removeprefix("run=").split("-"))) for n in runs}

    def runs(self, before: int) -> list[tuple[int, int]]:
        """Runs that hold the batches before one, the largest ones that fit; batches without a run added nothing."""
        spans = {}
        for level, index in self._present():
            size = self.fanout**level
            if (index + 1) * size <= before:
                spans.setdefault(index * size, []).append(level)
        found, at = [], -1
        for start in sorted(spans):
            if start >= at:
                level = max(spans[start])
                found.append((level, start // self.fanout**level))
                at = start + self.fanout**level
        return found

    def known(self, before: int, numbers: Sequence[int]) -> DataFrame:
        """Keys of the batches before one, in some buckets."""
        return read_buckets(self.spark, [self._run(*r) for r in self.runs(before)], self.path, KEY_SCHEMA, numbers)

    def add(self, keys: DataFrame, batch: int) -> None:
        """The keys of a batch; a replayed one replaces what it wrote before."""
        self._write(keys.select("file_id", "service_key", "tag_norm"), 0, batch)

    def _write(self, keys: DataFrame, level: int, index: int) -> None:
        write_buckets(keys, self._run(level, index), self.buckets)
        if (level, index) not in self._present():
            raise ValueError("runs need the _SUCCESS files of Spark's file committer; do not switch them off")

    def compact(self, batch: int) -> None:
        """Merge the runs that are complete before a batch; afterwards their parts are gone."""
        size, level = self.fanout, 1
        while batch and batch % size == 0:
            index = batch // size - 1
            present = self._present()
            parts = [(level - 1, i) for i in range(index * self.fanout, (index + 1) * self.fanout)]
            there = [self._run(*p) for p in parts if p in present]
            if (level, index) not in present and there:
                whole = read_buckets(self.spark, there, self.path, KEY_SCHEMA, range(self.buckets))
                self._write(whole, level, index)
            for part in there:
                files, place = _files(self.spark, part)
                files.delete(place, True)
            size, level = size * self.fanout, level + 1

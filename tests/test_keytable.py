"""Bucketed tables and the key log: what is read, what is merged, and replays."""

from __future__ import annotations

import random

import pytest
from conftest import got, table
from pyspark.sql import functions as F

from tagspark.functions.text import normalize_tag
from tagspark.operators.diff import filter_new_tags
from tagspark.streaming import apply
from tagspark.streaming.keytable import KEY_SCHEMA, BucketTable, KeyLog, bucket_of, touched
from tagspark.streaming.tables import written

BUCKETS = 8


def keys(spark, *rows):
    return table(spark, KEY_SCHEMA, *rows)


def files_read(df):
    return {row[0] for row in df.select(F.input_file_name()).distinct().collect()}


def test_a_batch_reads_the_buckets_it_touches(spark, tmp_path):
    stored = keys(spark, *[(i * 977, "s", f"tag {i}") for i in range(400)], (None, "s", "x"))
    base = BucketTable(stored, str(tmp_path / "base"), BUCKETS)
    batch = keys(spark, (0, "s", "a"), (399 * 977, "s", "b"))  # ids far apart
    numbers = touched(batch, BUCKETS)
    found = base.rows(numbers)
    assert 1 <= len(numbers) <= 2
    assert got(found) == got(stored.where(bucket_of(buckets=BUCKETS).isin(numbers)))
    assert {f.split("_bucket=")[1].split("/")[0] for f in files_read(found)} == set(map(str, numbers))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [_bucket" in plan
    assert base.rows([]).count() == 0


@pytest.mark.parametrize("fanout", [2, 3, 4])
def test_the_log_holds_all_keys_in_few_runs(spark, tmp_path, fanout):
    log = KeyLog(spark, str(tmp_path / "log"), BUCKETS, fanout)
    draw = random.Random(fanout)
    added = {}
    for batch in range(19):
        rows = [(draw.randrange(50), "s", f"t{batch}-{k}") for k in range(draw.choice([0, 1, 5]))]
        log.compact(batch)
        assert got(log.known(batch, range(BUCKETS))) == sorted((r for b in added.values() for r in b), key=repr)
        runs = log.runs(batch)
        digits, rest = 0, batch
        while rest:
            digits, rest = digits + rest % fanout, rest // fanout
        assert len(runs) <= digits
        log.add(keys(spark, *rows), batch)
        added[batch] = rows
    assert len(log._present()) <= 2 * fanout * 5


def test_a_replayed_batch_sees_what_it_saw(spark, tmp_path):
    log = KeyLog(spark, str(tmp_path / "log"), BUCKETS, 2)
    for batch in range(4):
        log.compact(batch)
        log.add(keys(spark, (batch, "s", "t")), batch)
    log.compact(4)
    before = got(log.known(4, range(BUCKETS)))
    log.add(keys(spark, (4, "s", "half written")), 4)
    log.compact(4)
    assert got(log.known(4, range(BUCKETS))) == before == [(k, "s", "t") for k in range(4)]
    log.add(keys(spark, (4, "s", "t")), 4)
    log.compact(5)
    assert got(log.known(5, range(BUCKETS))) == [(k, "s", "t") for k in range(5)]


def test_a_run_without_its_mark_is_not_there(spark, tmp_path):
    log = KeyLog(spark, str(tmp_path / "log"), BUCKETS, 2)
    for batch in range(2):
        log.add(keys(spark, (batch, "s", "t")), batch)
    whole = got(log.known(2, range(BUCKETS)))
    (tmp_path / "log" / "run=1-0").mkdir()  # a merge that was cut off
    log.compact(2)
    assert log.runs(2) == [(1, 0)] and got(log.known(2, range(BUCKETS))) == whole


def test_twelve_batches_of_apply_equal_one_diff(spark, tmp_path):
    schema = "file_id bigint, pos bigint, tag string"
    draw = random.Random(5)
    folder, every = str(tmp_path / "in"), []
    for _ in range(12):
        rows = [(draw.randrange(30), k, f"tag_{draw.randrange(9)}") for k in range(20)]
        every += rows
        table(spark, schema, *rows).coalesce(1).write.mode("append").parquet(folder)
    stored = table(spark, "file_id bigint, service_key string, tag string", *[(i, draw.choice("st"), "Tag-3") for i in range(30)])
    stored = stored.withColumn("tag_norm", normalize_tag("tag"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    apply.stream_apply(stream, stored, "s", out, str(tmp_path / "state"), buckets=BUCKETS, fanout=3)
    wanted = filter_new_tags(table(spark, schema, *every), stored, "s")
    assert got(written(spark, out), "file_id", "tag_norm") == got(wanted, "file_id", "tag_norm")
    assert KeyLog(spark, f"{out}_keys", BUCKETS, 3).runs(12)[0] == (2, 0)

"""Ordered scans against plain windows, with one group holding most rows and tiny chunks."""

from __future__ import annotations

import pytest
from pyspark.sql import Window, functions as F

from tagspark.operators import ordered as O
from tagspark.operators import skew


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(3000).select(
        F.when(i % 3 > 0, F.lit(0)).otherwise(i % 50).alias("g"),
        (i % 2).alias("m"),
        ((i * 7919) % 20011).alias("pos"),
        i.alias("v"),
    )


def test_running_totals_equal_plain_windows(rows):
    ours = O.running_totals(rows, "pos", {"s": F.col("v"), "n": F.lit(1)}, ["g"], ["m"])
    plain = Window.partitionBy("g").orderBy("m", "pos").rowsBetween(Window.unboundedPreceding, 0)
    both = ours.withColumn("s2", F.sum("v").over(plain)).withColumn("n2", F.count("*").over(plain))
    assert both.count() == 3000
    assert both.where("s <> s2 or n <> n2").count() == 0


def test_ordinal_is_dense_over_the_whole_table(rows):
    o = O.with_ordinal(rows.drop("g"), "pos", major=["m"])
    assert [r[0] for r in o.orderBy("m", "pos").select("ordinal").collect()] == list(range(3000))


def test_rows_without_a_position_are_kept(spark):
    df = spark.createDataFrame([(None, 1), (3, 1), (5, 1)], "pos bigint, v int")
    assert O.running_totals(df, "pos", {"s": F.col("v")}).count() == 3


@pytest.mark.parametrize("chunk_rows", [5, 64, 100_000])
def test_lookback_frames_are_complete(spark, chunk_rows):
    df = spark.range(500).select(F.lit(1).alias("g"), F.col("id").alias("pos"), (F.col("id") * 3).alias("v"))
    seen = O.with_lookback(df, "pos", 4, ["g"], chunk_rows)
    ours = seen.withColumn("s", F.sum("v").over(O.over_recent("pos", 4, ["g"]))).where("_own")
    plain = Window.partitionBy("g").orderBy("pos").rowsBetween(-4, 0)
    both = ours.withColumn("s2", F.sum("v").over(plain))
    assert both.count() == 500 and both.where("s <> s2").count() == 0


def test_neighbours_cross_ranges_and_gaps(rows):
    ours = O.neighbours_of(rows, "pos", "v")
    w = Window.orderBy("pos")
    both = ours.withColumn("p", F.lag("v").over(w)).withColumn("n", F.lead("v").over(w))
    assert both.where("not (previous <=> p) or not (next <=> n)").count() == 0


def test_no_task_sees_all_rows(spark):
    """Hashed positions: ranges stay even, and the only single task sees one row per range."""
    sparse = spark.range(200_000).select(F.xxhash64("id").alias("pos"), F.col("id").alias("v"))
    ranges = O.range_buckets(sparse, ["pos"]).groupBy(O.RANGE).count().collect()
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 3 * 200_000 / len(ranges)
    plan = O.with_ordinal(sparse, "pos")._jdf.queryExecution().executedPlan().toString()
    single = plan.split("Exchange SinglePartition")
    assert len(single) == 2
    assert "HashAggregate(keys=[_range" in single[1].splitlines()[1]


def test_lookup_join_with_a_hot_key(spark):
    left = spark.range(20_000).select(
        F.col("id").alias("pos"), F.when(F.col("id") % 3 > 0, F.lit(5)).otherwise(F.col("id")).alias("k")
    )
    right = spark.range(15_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    ours = skew.lookup_join(left, right, "k", "pos")
    plain = left.join(right, "k", "left")
    assert ours.count() == 20_000
    assert ours.exceptAll(plain.select(ours.columns)).count() == 0
    hot = spark.range(1).select(skew.hot_keys(left, "k").alias("hot")).first()["hot"]
    assert hot == [5]
    salted = skew.salt_rows(left, "k", skew.hot_keys(left, "k"), "pos")
    assert salted.where("k = 5").select("_salt").distinct().count() == skew.SALTS
    assert salted.where("k <> 5").select("_salt").distinct().count() == 1


def test_shared_folder_is_the_named_one_or_an_own_one(spark, monkeypatch):
    from tagspark import session

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert session.shared_dir(spark) == named
    monkeypatch.setattr(session, "CHECKPOINT_CONF", "spark.no.such.setting")
    assert session.shared_dir(spark) == session.shared_dir(spark) != named
    assert session.cut_lineage(spark.range(5)).count() == 5


def test_range_totals_need_no_dense_order(spark):
    i = F.col("id")
    sparse = spark.range(2000).select(
        F.when(i % 3 == 0, F.lit(None)).otherwise(i % 4).alias("g"), F.xxhash64(i).alias("pos"), i.alias("v")
    )
    ours = O.range_totals(sparse, ["pos"], {"s": F.col("v")}, ["g"])
    plain = Window.partitionBy("g").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    both = ours.withColumn("s2", F.sum("v").over(plain))
    assert both.count() == 2000 and both.where("not (s <=> s2)").count() == 0

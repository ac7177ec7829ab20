"""Pages by rank against slices of the sorted list, and what a page reads."""

from __future__ import annotations

import random

import pytest
from conftest import table
from pyspark.sql import functions as F

from tagspark.operators import browse
from tagspark.operators.pages import PageIndex


@pytest.fixture(scope="module")
def rows():
    numbers = random.Random(3)
    sizes = [7] * 400 + [numbers.randrange(50) for _ in range(800)]
    made = [(i, None if i % 97 == 0 else size) for i, size in enumerate(sizes)]
    numbers.shuffle(made)
    return made


@pytest.fixture(scope="module")
def index(spark, rows):
    df = table(spark, "file_id bigint, size bigint", *rows)
    return PageIndex(df, ["size", "file_id"], range_rows=100)


def test_every_page_is_a_slice_of_the_order(index, rows):
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    for number in (0, 1, 5, 17, 29, 30):
        page = [tuple(r) for r in index.page(number, 40).collect()]
        assert page == ordered[number * 40 : number * 40 + 40]
    assert [r["position"] for r in index.rows(95, 305).collect()] == list(range(95, 305))


def test_a_deep_page_reads_only_its_ranges(index, rows):
    files = index.starts.count()
    assert files > 8
    assert len(index.page(28, 40).inputFiles()) <= 3
    assert sorted(r["n"] for r in index.starts.collect())[-1] < len(rows) / 3
    plan = index.page(28, 40)._jdf.queryExecution().explainString(
        index.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "TakeOrdered" not in plan and "Window" not in plan


def test_equal_order_values_are_spread_and_counted_once(spark, rows):
    df = table(spark, "file_id bigint, size bigint", *[(i, 1) for i in range(1_000)], (1_000, 0))
    index = PageIndex(df, ["size"], range_rows=100)
    assert max(r["n"] for r in index.starts.collect()) < 500
    seen = [r["file_id"] for n in range(26) for r in index.page(n, 40).collect()]
    assert sorted(seen) == list(range(1_001)) and seen[0] == 1_000


def test_descending_order_repeated_rows_and_maps(spark):
    df = table(spark, "pos bigint, file_id bigint", *[(i // 2, 5) for i in range(60)]).withColumn("m", F.create_map("pos", "pos"))
    index = PageIndex(df, [F.col("pos").desc()], range_rows=10)
    assert [r["pos"] for r in index.page(1, 7).collect()] == [26, 25, 25, 24, 24, 23, 23]


def test_a_page_of_nothing(spark):
    empty = PageIndex(table(spark, "pos bigint, file_id bigint"), ["pos"])
    assert empty.page(0, 10).collect() == []
    full = PageIndex(table(spark, "pos bigint, file_id bigint", (1, 2)), ["pos"])
    page = full.page(3, 10)
    assert page.collect() == [] and page.columns == ["pos", "file_id"]


def test_selecting_a_page_of_an_index(spark):
    queue = table(spark, "pos bigint, file_id bigint", *[(i, 100 + i) for i in range(10)])
    chosen = table(spark, "file_id bigint", (103,), (999,))
    found = browse.select_page(PageIndex(queue, ["pos"], range_rows=3), chosen, 1, 4)
    assert sorted(r[0] for r in found.collect()) == [103, 104, 105, 106, 107, 999]

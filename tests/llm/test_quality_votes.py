"""Quality by neighbours' votes: held-out accuracy, exact cosines, odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from conftest import got
from pyspark.sql import functions as F

from tagspark.llm import quality_votes as Q
from tagspark.llm import queries

from .conftest import files, words

MARKS = "file_id bigint, archived int, score double"


def marks(spark, *rows):
    return spark.createDataFrame([(*r, 0.1) for r in rows], MARKS)


def test_held_out_accuracy_on_the_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.QUERIES["op1_quality_classifier"](spark, folder)
    labels = queries.table(spark, folder, "labels")
    rows = found.join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert len(rows) > 100
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    low, high = ([r["score"] for r in rows if r["quality"] == q] for q in (0, 1))
    assert np.mean([h > x for h in high for x in low]) > 0.95
    assert found.count() == queries.table(spark, folder, "documents").count()


def test_marks_of_held_out_files_are_never_learned_from(spark):
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = files(spark, *[(i, words(i, 20), None) for i in ids])
    fitted = Q.fit_neighbourhood(rows, marks(spark, *[(i, i % 2) for i in ids]))
    assert len(fitted.vectors) == 0 and fitted.prior == 0
    assert got(rows.select(Q.held_out().alias("h")).distinct()) == [(True,)]


def test_votes_weigh_the_nearest_cosines():
    vectors = Q._unit(np.array([[1, 0], [1, 0.1], [0, 1]], np.float32))
    near = Q.Neighbourhood(np.eye(2, dtype=np.float32), vectors, np.array([1, 1, 0]), np.ones(3), 0.3)
    placed = Q._unit(np.array([[1, 0], [0, 1], [1, 1], [0, 0]], np.float32))
    cosines = np.clip(placed.astype(float) @ vectors.T.astype(float), 0, 1) ** Q.SHARPNESS
    wanted = (cosines * [1, 1, 0]).sum(axis=1)[:3] / cosines.sum(axis=1)[:3]
    assert near.votes(placed)[:3] == pytest.approx(wanted, abs=1e-6) and near.votes(placed)[3] == 0.3


def test_scores_do_not_depend_on_id_service_or_order(spark):
    draw = random.Random(4)
    good = [(i, words(i, 40), "a") for i in range(60)]
    bad = [(100 + i, " ".join(draw.choice(["#$%", "!!!", "BUY"]) for _ in range(40)), "b") for i in range(60)]
    given = marks(spark, *[(i, 1) for i, _, _ in good], *[(i, 0) for i, _, _ in bad], (None, 1), (5, None), (5, 1))
    df = files(spark, *good, *bad, (500, good[3][1], "b"), (501, bad[3][1], None))
    score = dict(got(Q.quality_votes(df.repartition(5), given), "file_id", "score"))
    assert score[500] == pytest.approx(score[3]) and score[501] == pytest.approx(score[103])
    assert min(score[i] for i, _, _ in good) > 0.5 > max(score[i] for i, _, _ in bad)
    bounded = Q.fit_neighbourhood(df, given, sample_per_mark=7)
    assert len(bounded.vectors) == 14


def test_odd_files(spark, odd_files, no_files):
    given = marks(spark, (1, 1), (6, 0), (4, 0), (9_999, 1))
    found = Q.quality_votes(odd_files, given)
    assert found.count() == odd_files.count()
    assert found.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0
    assert Q.quality_votes(no_files, given).collect() == []
    assert got(Q.quality_votes(odd_files, given.limit(0)).select(F.max("score"))) == [(0.0,)]

"""Media fetched in the task that scores them: routes, overlap, failures, plan."""

from __future__ import annotations

import time

import pytest
from conftest import got, table

from tagspark.operators import scoring
from tagspark.operators.planning import SkipRules
from tagspark.sources.media import route_media

LABELS = "label_idx int, tag_id int, name string, category int, count bigint"


def fetcher(full, thumbs, log=None):
    def make():
        def fetch(file_id, kind):
            if log:
                with open(log, "a") as out:
                    out.write(f"{file_id} {kind}\n")
            found = (full if kind == "full" else thumbs).get(file_id)
            if isinstance(found, Exception):
                raise found
            return found

        return fetch

    return make


def lengths():
    def make():
        def predict(contents):
            if any(c == b"bad" for c in contents):
                raise RuntimeError("cannot score")
            return [[float(len(c))] for c in contents]

        return predict

    return make


def scored(spark, rows, full, thumbs, **more):
    files = table(spark, "file_id bigint, mime string", *rows)
    found = scoring.fetch_and_score(route_media(files), fetcher(full, thumbs), lengths(), tasks=1, **more)
    return got(found)


def test_routes_and_fallback(spark):
    rows = [(1, "image/png"), (2, " Video/MP4 "), (3, None), (4, "image/png"), (5, "video/webm"), (None, "image/png")]
    full = {1: b"full", 2: b"never read", 3: None, 5: b"never read"}
    thumbs = {1: b"t", 2: b"th", 3: b"thumb"}
    none = (None, "media", "no readable file or thumbnail")
    assert scored(spark, rows, full, thumbs) == sorted(
        [(1, [4.0], None, None), (2, [2.0], None, None), (3, [5.0], None, None), (4, *none), (5, *none), (None, *none)], key=repr
    )


def test_a_failing_batch_is_lost_or_tried_alone(spark):
    rows = [(i, "image/png") for i in range(6)]
    full = {i: b"x" * (i + 1) for i in range(6)} | {2: b"bad", 4: OSError("gone")}
    fetch = (4, None, "fetch", "OSError: gone")
    predict = (None, "predict", "RuntimeError: cannot score")
    alone = scored(spark, rows, full, {}, alone=True, batch_size=256)
    assert alone == [(i, [float(i + 1)], None, None) if i not in (2, 4) else fetch if i == 4 else (2, *predict) for i in range(6)]
    whole = scored(spark, rows, full, {}, batch_size=256)
    assert whole == [fetch if i == 4 else (i, *predict) for i in range(6)]


def test_files_are_fetched_at_once_and_ahead(spark):
    def slow():
        def fetch(file_id, kind):
            time.sleep(0.2)
            return b"x"

        return fetch

    files = route_media(table(spark, "file_id bigint, mime string", *[(i, "image/png") for i in range(16)]))
    scoring.fetch_and_score(files, slow, lengths(), tasks=1).count()  # workers are up
    start = time.time()
    assert scoring.fetch_and_score(files, slow, lengths(), batch_size=8, parallel=8, tasks=1).count() == 16
    assert time.time() - start < 0.6 * 16 * 0.2


@pytest.mark.parametrize("batch_size, parallel", [(0, 0), (1, 1), (10_000, 99)])
def test_knobs_are_clamped(spark, batch_size, parallel):
    rows = [(i, "image/png") for i in range(5)]
    found = scored(spark, rows, {i: b"x" for i in range(5)}, {}, batch_size=batch_size, parallel=parallel)
    assert found == [(i, [1.0], None, None) for i in range(5)]
    assert scored(spark, rows[:0] or [(0, None)], {0: b"y"}, {}) == [(0, [1.0], None, None)]


def test_only_wanted_files_are_read_and_no_bytes_are_shuffled(spark, tmp_path):
    log = str(tmp_path / "log")
    queue = table(spark, "pos bigint, file_id bigint", (0, 1), (1, 2), (2, 3), (3, 1))
    files = table(spark, "file_id bigint, mime string", (1, "image/png"), (2, "image/png"), (3, "image/png"), (9, "image/png"))
    tags = table(spark, "file_id bigint, service_key string, status string, pos bigint, tag string, tag_norm string", (2, "s", "0", 0, "wd14:wd-vit-tagger-v3", "wd14:wd vit tagger v3"))
    labels = table(spark, LABELS, (0, 0, "gen0", 0, 1))

    def make():
        return lambda contents: [[0.9] for _ in contents]

    results, rejects = scoring.score_pending_media(
        queue, files, tags, labels, fetcher({1: b"a", 3: None}, {}, log), make, SkipRules()
    )
    assert got(results, "pos", "file_id", "skipped_inference", "tags") == [
        (0, 1, False, ["gen0", "wd14:wd-vit-tagger-v3"]),
        (1, 2, True, []),
        (3, 1, False, ["gen0", "wd14:wd-vit-tagger-v3"]),
    ]
    assert got(rejects) == [(3, "media", "no readable file or thumbnail")]
    assert sorted(open(log).read().split("\n")[:-1]) == ["1 full", "3 full", "3 thumbnail"]
    found = scoring.fetch_and_score(scoring.wanted_media(table(spark, "file_id bigint, skip_reason string", (1, None)), files), fetcher({}, {}), make)
    assert "binary" not in found._jdf.queryExecution().analyzed().toString() and all(kind != "binary" for _, kind in found.dtypes)

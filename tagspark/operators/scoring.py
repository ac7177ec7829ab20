"""Scoring files with a classifier that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from tagspark.defaults import CHARACTER_THRESHOLD, FETCH_PARALLEL, GENERAL_THRESHOLD, SCORE_BATCH
from tagspark.operators.planning import SkipRules, skip_decisions
from tagspark.operators.scores import build_results, threshold_scores
from tagspark.operators.skew import lookup_join
from tagspark.session import cut_lineage
from tagspark.sources.media import route_media


def forgiving(make_predict_fn: Callable) -> Callable:
    """A batch that the classifier fails on gives empty vectors instead of ending the job."""

    def make():
        import logging

        import numpy as np

        predict = make_predict_fn()

        def run(*inputs):
            try:
                return predict(*inputs)
            except Exception:
                logging.getLogger("tagspark.scoring").exception("batch of %d failed", len(inputs[0]))
                return np.zeros((len(inputs[0]), 0), dtype=np.float32)

        return run

    return make


def score_files(
    df: DataFrame,
    make_predict_fn: Callable,
    inputs: list[str],
    batch_size: int = SCORE_BATCH,
    input_tensor_shapes: list | None = None,
) -> DataFrame:
    """Adds `probs`; rows of a failed batch drop out.

    `make_predict_fn` builds the classifier once per Python worker and returns a function from
    input batches to a float array (rows, labels).
    """
    predict = predict_batch_udf(
        forgiving(make_predict_fn),
        return_type=ArrayType(FloatType()),
        batch_size=max(1, min(256, int(batch_size))),
        input_tensor_shapes=input_tensor_shapes,
    )
    # Marked as nondeterministic, or the filter would move below and score every file again.
    return df.withColumn("probs", predict.asNondeterministic()(*inputs)).where(F.size("probs") > 0)


def score_pending(
    queue: DataFrame,
    files: DataFrame,
    file_tags: DataFrame,
    media: DataFrame,
    labels: DataFrame,
    make_predict_fn: Callable,
    inputs: list[str],
    rules: SkipRules = SkipRules(),
    general_threshold: float = GENERAL_THRESHOLD,
    character_threshold: float = CHARACTER_THRESHOLD,
    append_marker: bool = True,
    batch_size: int = SCORE_BATCH,
    input_tensor_shapes: list | None = None,
    **prefixes: str,
) -> DataFrame:
    """Results of a run: pos, file_id, skip fields, tags.

    Skipped files never reach the classifier, and a file that is queued twice is scored once.
    `media` holds file_id and the input columns.
    """
    decisions = cut_lineage(skip_decisions(queue, files, file_tags, rules).drop("missing"), "decisions")
    wanted = decisions.where(F.col("skip_reason").isNull()).select("file_id").distinct()
    scored = score_files(
        media.join(wanted, "file_id", "left_semi"), make_predict_fn, inputs, batch_size, input_tensor_shapes
    ).select("file_id", "probs")
    tagged = threshold_scores(scored, labels, general_threshold, character_threshold)
    return _with_results(decisions, tagged, rules, append_marker, prefixes)


def _with_results(decisions: DataFrame, tagged: DataFrame, rules: SkipRules, append_marker: bool, prefixes: dict) -> DataFrame:
    results = build_results(
        tagged, rules.marker, append_marker, rules.marker_prefix, **prefixes
    ).select("file_id", "general_tags", "character_tags", "rating_tags", "tags", "stale_markers_removed")
    kept = decisions.select("pos", "file_id", "skip_reason")
    skipped = F.col("skip_reason").isNotNull()
    joined = lookup_join(kept, results, "file_id", "pos").where(skipped | F.col("tags").isNotNull())
    empty = F.array().cast("array<string>")
    return joined.select(
        "pos",
        "file_id",
        skipped.alias("skipped_inference"),
        "skip_reason",
        F.when(skipped, F.lit(rules.marker)).alias("marker"),
        *[F.when(~skipped, F.col(c)).alias(c) for c in ("general_tags", "character_tags", "rating_tags")],
        F.when(skipped, empty).otherwise(F.col("tags")).alias("tags"),
        F.when(skipped, F.lit(0)).otherwise(F.col("stale_markers_removed")).alias("stale_markers_removed"),
    )


SCORED = "file_id bigint, probs array<float>, stage string, error string"


def _loaded(fetch: Callable, file_id: int, route: str) -> tuple[bytes | None, str | None, str | None]:
    """Bytes of a file: the file itself unless its route is `thumbnail`, else its thumbnail; or where and why it failed."""
    try:
        content = None if route == "thumbnail" else fetch(file_id, "full")
        content = fetch(file_id, "thumbnail") if content is None else content
    except Exception as error:
        return None, "fetch", f"{type(error).__name__}: {error}"
    return (content, None, None) if content is not None else (None, "media", "no readable file or thumbnail")


def _predicted(predict: Callable, contents: list[bytes], alone: bool) -> list[tuple]:
    """(probs, stage, error) of each of a batch; one that fails is tried file by file if `alone`."""
    try:
        return [(probs, None, None) for probs in predict(contents)]
    except Exception as error:
        if alone and len(contents) > 1:
            return [found for content in contents for found in _predicted(predict, [content], alone)]
        return [(None, "predict", f"{type(error).__name__}: {error}")] * len(contents)


def fetch_and_score(
    wanted: DataFrame,
    make_fetch_fn: Callable,
    make_predict_fn: Callable,
    batch_size: int = SCORE_BATCH,
    parallel: int = FETCH_PARALLEL,
    alone: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """file_id, probs, stage and error of each row of `wanted` (file_id, route); no media bytes leave the task.

    `make_fetch_fn` builds, once per task, a function from a file id and `full` or `thumbnail` to
    bytes, or None where there are none to be decoded; `make_predict_fn` one from a list of such
    bytes to float vectors. Videos are read as thumbnails, other files whole with the thumbnail to
    fall back on. Up to `parallel` files (1 to 32) are fetched at once, and the next batch is fetched
    while one is scored, so that a task holds the bytes of two batches. A file that cannot be scored
    has no probs, but the stage (`fetch`, `media` or `predict`) and the error; a batch that the
    classifier fails on is lost as a whole, or with `alone` tried file by file.

    Ids are tiny and what they cost is not, so they are dealt into `tasks` parts (by default
    `spark.sql.shuffle.partitions`) that are not put together by their size.
    """
    size, threads = max(1, min(256, int(batch_size))), max(1, min(32, int(parallel)))

    def run(batches: Iterator) -> Iterator:
        from collections import deque
        from concurrent.futures import ThreadPoolExecutor
        from itertools import islice

        import pyarrow as pa

        fetch = predict = None
        rows = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in ("file_id", "route")], strict=True))
        with ThreadPoolExecutor(threads) as pool:
            ahead: deque = deque()
            while True:
                while len(ahead) < 2 and (part := list(islice(rows, size))):
                    fetch = fetch or make_fetch_fn()
                    ahead.append((part, [pool.submit(_loaded, fetch, *row) for row in part]))
                if not ahead:
                    return
                part, futures = ahead.popleft()
                loaded = [future.result() for future in futures]
                good = [content for content, _, _ in loaded if content is not None]
                if good:
                    predict = predict or make_predict_fn()
                found = iter(_predicted(predict, good, alone) if good else [])
                out = [next(found) if content is not None else (None, stage, error) for content, stage, error in loaded]
                probs = [None if p is None else [float(v) for v in p] for p, _, _ in out]
                columns = [pa.array([row[0] for row in part], pa.int64()), pa.array(probs, pa.list_(pa.float32()))]
                columns += [pa.array([o[k] for o in out], pa.string()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(columns, names=["file_id", "probs", "stage", "error"])

    n = tasks or int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted.select("file_id", "route").repartition(n, "file_id").mapInArrow(run, SCORED)


def wanted_media(decisions: DataFrame, files: DataFrame) -> DataFrame:
    """file_id and route of the files that a plan wants scored, each once."""
    wanted = decisions.where(F.col("skip_reason").isNull()).select("file_id").distinct()
    return route_media(wanted.join(files.select("file_id", "mime"), "file_id")).select("file_id", "route")


def score_pending_media(
    queue: DataFrame,
    files: DataFrame,
    file_tags: DataFrame,
    labels: DataFrame,
    make_fetch_fn: Callable,
    make_predict_fn: Callable,
    rules: SkipRules = SkipRules(),
    general_threshold: float = GENERAL_THRESHOLD,
    character_threshold: float = CHARACTER_THRESHOLD,
    append_marker: bool = True,
    batch_size: int = SCORE_BATCH,
    parallel: int = FETCH_PARALLEL,
    alone: bool = False,
    **prefixes: str,
) -> tuple[DataFrame, DataFrame]:
    """Results of a run as `score_pending` gives them, and the files that it lost: file_id, stage, error.

    Bytes are fetched for files to score only, by `fetch_and_score`, in one pass that is written and
    gives both tables.
    """
    decisions = cut_lineage(skip_decisions(queue, files, file_tags, rules).drop("missing"), "decisions")
    found = fetch_and_score(wanted_media(decisions, files), make_fetch_fn, make_predict_fn, batch_size, parallel, alone)
    found = cut_lineage(found, "scored-media")
    scored = found.where(F.col("stage").isNull()).select("file_id", "probs")
    tagged = threshold_scores(scored, labels, general_threshold, character_threshold)
    rejects = found.where(F.col("stage").isNotNull()).select("file_id", "stage", "error")
    return _with_results(decisions, tagged, rules, append_marker, prefixes), rejects

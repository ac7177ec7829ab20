"""Run logs: digest, sample errors, and sessions put together from their log lines.

Input rows are (run_id, line_no, line); line_no counts from 0 within a run. A single run may be
most of the data, so no step gathers a run in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagspark.defaults import CHUNK_ROWS
from tagspark.functions import loglines as L
from tagspark.functions.text import strip
from tagspark.operators.ordered import chunk_of
from tagspark.session import cut_lineage

CONFIG_LOOK_BACK = 40
METRICS_LOOK_BACK = 7
RATES_LOOK_AHEAD = 4
SAMPLE_ERRORS = 8
SAMPLE_CHARS = 500
_SUMS = [f"sum_{name}" for name in L.SCORING_FIELDS]


def log_digest(lines: DataFrame) -> DataFrame:
    """Per run: number of lines and one counter per keyword; a line may count for several."""
    counters = L.digest_counters("line")
    return lines.groupBy("run_id").agg(
        F.count("*").alias("lines"), *[F.count_if(hit).alias(name) for name, hit in counters.items()]
    )


def sample_errors(lines: DataFrame, samples: int = SAMPLE_ERRORS) -> DataFrame:
    """The first error lines of each run, stripped and cut: run_id, n (from 1), line.

    The rank limit is applied before the shuffle, so each task sends at most `samples` per run.
    """
    first = Window.partitionBy("run_id").orderBy("line_no")
    errors = lines.where(F.contains("line", F.lit(L.ERROR_MARK)))
    return (
        errors.withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= samples)
        .select("run_id", "n", F.substring(strip("line"), 1, SAMPLE_CHARS).alias("line"))
    )


def latest_run(lines: DataFrame, modified: str = "modified_at") -> DataFrame:
    """The run whose file was modified last; of equal times the greatest run id."""
    newest = F.max(F.struct(modified, "run_id")).alias("newest")
    return lines.agg(newest).select("newest.run_id", F.col(f"newest.{modified}").alias(modified))


def last_shutdown(lines: DataFrame) -> DataFrame:
    """Last shutdown line per run."""
    found = lines.where(F.contains("line", F.lit(L.SHUTDOWN_MARK)))
    return found.groupBy("run_id").agg(strip(F.max_by("line", "line_no")).alias("shutdown"))


def _has(mark: str) -> Column:
    return F.contains(F.col("line"), F.lit(mark))


def _marked_lines(lines: DataFrame) -> DataFrame:
    """Only the lines that session building reads: one flag per kind, numbers of scoring lines.

    Scoring lines are the many ones; their text is dropped once the numbers are out of it.
    """
    flags = {
        "is_prefetch": _has(L.PREFETCH_MARK),
        "is_perf": _has(L.PERF_MARK) & _has("wall_s="),
        "is_queue": _has(L.QUEUE_MARK),
        "is_metrics": _has(L.METRICS_MARK),
        "is_rates": _has(L.RATES_MARK),
        "is_config": _has(L.CONFIG_MARK),
        "is_scoring": _has(L.SCORING_MARK) & _has(L.SCORING_WALL_MARK),
    }
    useful = lines.where(F.rlike("line", F.lit(L.SESSION_LINES))).select(
        "run_id", "line_no", "line", *[flag.alias(name) for name, flag in flags.items()]
    )
    only_scoring = F.col("is_scoring")
    for name in flags:
        if name != "is_scoring":
            only_scoring = only_scoring & ~F.col(name)
    # A column of its own, so that a line is read once for all its numbers.
    useful = useful.withColumn("_numbers", L.metrics_record(F.when(F.col("is_scoring"), F.col("line"))))
    numbers = [
        F.coalesce(F.col(f"_numbers.{name}"), F.lit(0).cast(kind)).alias(f"sum_{name}")
        for name, (_, kind, _) in L.SCORING_FIELDS.items()
    ]
    return useful.select(
        "run_id", "line_no", F.when(~only_scoring, F.col("line")).alias("line"), *flags, *numbers
    )


def parse_sessions(
    lines: DataFrame,
    lookbehind: int = 0,
    pairing: str = "ordinal",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per prefetch line: the session that it starts.

    The r-th prefetch line of a run is paired with its r-th perf line (`pairing="next"`: with the
    first perf line after it). A session covers the lines from one to the other, or to the end of
    the run when the perf line is missing; sums over it are differences of running totals, so
    sessions may overlap without any line being copied. Other lines are looked up at a bounded
    distance: config up to 40 lines before the start (the earliest), session metrics up to 7 lines
    before the end (the nearest), rates up to 4 lines after it (the nearest; `lookbehind` also
    searches that many lines before it when there is none).
    """
    # The log is read once; all that follows works on the few lines kept here.
    marked = cut_lineage(_marked_lines(lines), "log-lines")
    anchors = _anchors(marked, lookbehind, chunk_rows)
    starts = {
        "start_line": "line_no",
        "_start_text": "line",
        "_config": "_config_text",
        "_queue_at": "_queue_at",
        "_queue_text": "_queue_text",
        **{f"_from_{n}": f"from_{n}" for n in _SUMS},
        **{f"_run_{n}": f"run_{n}" for n in _SUMS},
    }
    ends = {
        "end_line": "line_no",
        "_end_text": "line",
        "_metrics_at": "_metrics_at",
        "_metrics_text": "_metrics_text",
        "_rates_text": "_rates_text",
        **{f"_to_{n}": f"upto_{n}" for n in _SUMS},
    }

    def columns(names: dict[str, str]) -> Column:
        return F.struct(*[F.col(column).alias(name) for name, column in names.items()])

    if pairing == "next":
        # A prefetch line that follows k perf lines ends at perf line k + 1; several may share it.
        first = anchors.where("is_prefetch").select(
            "run_id", F.col("n_prefetch").alias("session"), (F.col("n_perf") + 1).alias("_pair"), columns(starts).alias("s")
        )
        second = anchors.where("is_perf").select("run_id", F.col("n_perf").alias("_pair"), columns(ends).alias("e"))
        paired = first.join(second, ["run_id", "_pair"], "left")
    else:
        # Both lines carry the number of the session, so one grouping brings them together.
        numbered = anchors.withColumn("session", F.when(F.col("is_prefetch"), F.col("n_prefetch")).otherwise(F.col("n_perf")))
        paired = (
            numbered.groupBy("run_id", "session")
            .agg(
                F.max(F.when(F.col("is_prefetch"), columns(starts))).alias("s"),
                F.max(F.when(~F.col("is_prefetch"), columns(ends))).alias("e"),
            )
            .where(F.col("s").isNotNull())
        )
    return paired.select("run_id", "session", "s.*", "e.*").select(
        "run_id", "session", "start_line", "end_line", *_session_fields(_SUMS)
    )


def _session_fields(totals: list[str]) -> list[Column]:
    has_end = F.col("end_line").isNotNull()
    inside = F.coalesce(F.col("end_line") >= F.col("start_line"), F.lit(True))
    queue_inside = F.col("_queue_at") <= F.coalesce("end_line", "_queue_at")
    # The metrics line must come after the start line of the session.
    metrics_inside = F.col("_metrics_at") > F.col("start_line")

    def total(name: str) -> Column:
        upto = F.when(has_end, F.col(f"_to_{name}")).otherwise(F.col(f"_run_{name}"))
        value = F.when(inside, upto - F.col(f"_from_{name}")).otherwise(F.lit(0))
        if name.endswith("_s"):
            return F.round(F.coalesce(value, F.lit(0)), 3).cast("double").alias(name)
        return F.coalesce(value, F.lit(0)).cast("bigint").alias(name)

    def fields(text: Column, shape: dict) -> list[Column]:
        rec = L.record(text, shape)
        return [
            rec[n].cast("double").alias(n) if kind.startswith("decimal") else rec[n].alias(n)
            for n, (_, kind, _) in shape.items()
        ]

    start = L.record("_start_text", L.PREFETCH)
    config = L.config_record("_config")
    return [
        F.coalesce(start["prefetch_s"].cast("double"), F.lit(0.0)).alias("prefetch_s"),
        F.coalesce(start["prefetch_rows"], F.lit(0)).alias("prefetch_rows"),
        *[total(n) for n in totals],
        *fields(F.col("_end_text"), L.PERF),
        *fields(F.when(metrics_inside, F.col("_metrics_text")), L.SESSION_METRICS),
        *fields(F.col("_rates_text"), L.RATES),
        *fields(F.when(queue_inside & inside, F.col("_queue_text")), L.QUEUE),
        *[config[n].alias(n) for n in L.CONFIG_FIELDS],
    ]


def _anchors(marked: DataFrame, lookbehind: int, chunk_rows: int) -> DataFrame:
    """Prefetch and perf lines with their numbers, running totals and the lines looked up.

    Lines are spread by (run, chunk). A chunk also sees the lines within reach on both sides, so
    every look-up frame is complete; totals count its own lines only. What lies before or after a
    chunk comes from a table with one row per chunk.
    """
    reach = max(CONFIG_LOOK_BACK, METRICS_LOOK_BACK, RATES_LOOK_AHEAD, lookbehind)
    size = max(chunk_rows, 2 * reach + 1)
    chunk, offset = chunk_of("line_no", size), F.col("line_no") % size
    home = F.col("_home") == F.col("_chunk")
    measures = {
        "n_prefetch": F.col("is_prefetch").cast("bigint"),
        "n_perf": F.col("is_perf").cast("bigint"),
        **{f"upto_{n}": F.col(n) for n in _SUMS},
    }

    def text(flag: str) -> Column:
        return F.when(F.col(flag), F.struct("line_no", "line"))

    # Per chunk: totals before it and over the run, and the first queue line after it.
    chunks = marked.groupBy("run_id", chunk.alias("_chunk")).agg(
        *[F.sum(v).alias(f"_all_{n}") for n, v in measures.items()], F.min(text("is_queue")).alias("_queue")
    )
    run = Window.partitionBy("run_id")
    along = run.orderBy("_chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # What comes next is the last one met when going backwards: such a frame only grows.
    after = run.orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    edges = chunks.select(
        "run_id",
        "_chunk",
        *[F.sum(f"_all_{n}").over(before).alias(f"_before_{n}") for n in measures],
        *[F.sum(f"_all_upto_{n}").over(run).alias(f"run_{n}") for n in _SUMS],
        F.last("_queue", ignorenulls=True).over(after).alias("_later_queue"),
    )

    copies = F.array_compact(
        F.array(
            chunk,
            F.when(offset >= size - reach, chunk + 1),
            F.when((offset < reach) & (chunk > 0), chunk - 1),
        )
    )
    spread = marked.withColumn("_home", chunk).select("*", F.explode(copies).alias("_chunk"))
    by_line = Window.partitionBy("run_id", "_chunk").orderBy("line_no")
    upto_here = by_line.rowsBetween(Window.unboundedPreceding, 0)
    backwards = Window.partitionBy("run_id", "_chunk").orderBy(F.desc("line_no"))
    from_here = backwards.rowsBetween(Window.unboundedPreceding, 0)

    rates = F.first(text("is_rates"), ignorenulls=True).over(by_line.rangeBetween(0, RATES_LOOK_AHEAD))
    if lookbehind > 0:
        earlier = F.last(text("is_rates"), ignorenulls=True).over(by_line.rangeBetween(-int(lookbehind), 0))
        rates = F.coalesce(rates, earlier)
    seen = spread.select(
        "*",
        *[F.sum(F.when(home, v)).over(upto_here).alias(f"_in_{n}") for n, v in measures.items()],
        F.last(F.when(home, text("is_queue")), ignorenulls=True).over(from_here).alias("_own_queue"),
        F.first(text("is_config"), ignorenulls=True).over(by_line.rangeBetween(-CONFIG_LOOK_BACK, 0)).alias("_config"),
        F.last(text("is_metrics"), ignorenulls=True).over(by_line.rangeBetween(-METRICS_LOOK_BACK, 0)).alias("_metrics"),
        rates.alias("_rates"),
    )
    found = seen.where(home & (F.col("is_prefetch") | F.col("is_perf"))).join(edges, ["run_id", "_chunk"], "left")
    queue = F.coalesce("_own_queue", "_later_queue")
    totals = {n: F.col(f"_in_{n}") + F.coalesce(f"_before_{n}", F.lit(0)) for n in measures}
    return found.select(
        "run_id",
        "line_no",
        "line",
        "is_prefetch",
        "is_perf",
        *[total.alias(n) for n, total in totals.items()],
        *[(totals[f"upto_{n}"] - F.col(n)).alias(f"from_{n}") for n in _SUMS],
        *[f"run_{n}" for n in _SUMS],
        queue["line_no"].alias("_queue_at"),
        queue["line"].alias("_queue_text"),
        F.col("_config.line").alias("_config_text"),
        F.col("_metrics.line_no").alias("_metrics_at"),
        F.col("_metrics.line").alias("_metrics_text"),
        F.col("_rates.line").alias("_rates_text"),
    )


def session_sums(sessions: DataFrame) -> DataFrame:
    """Scoring seconds and file counts per session."""
    return sessions.select("run_id", "session", *[f"sum_{n}" for n in L.SCORING_FIELDS])


def session_report(sessions: DataFrame) -> DataFrame:
    """One row per session with the fourteen report columns as text."""
    dash = F.lit("—")
    ended = F.col("wall_s").isNotNull()

    def shown(value: Column, missing: Column = dash) -> Column:
        return F.when(ended, F.coalesce(value, missing)).otherwise(F.lit(""))

    def fixed(name: str, places: int) -> Column:
        return F.format_string(f"%.{places}f", F.col(name))

    def text(name: str) -> Column:
        return F.col(name).cast("string")

    config = F.concat_ws("/", *[text(n) for n in L.CONFIG_FIELDS])
    return sessions.select(
        F.col("run_id"),
        F.col("session").alias("run"),
        F.when(F.col("config_batch").isNull(), F.lit("")).otherwise(config).alias("config"),
        F.when(ended, fixed("prefetch_s", 3)).otherwise(F.lit("…")).alias("prefetch"),
        F.when(ended, fixed("wall_s", 3)).otherwise(F.lit("(no perf line in segment)")).alias("wall"),
        shown(text("sum_predict_s")).alias("predict"),
        shown(fixed("sum_fetch_s", 3)).alias("fetch"),
        shown(text("batches")).alias("batches"),
        shown(text("processed")).alias("processed"),
        shown(text("skipped_same")).alias("skip_same"),
        shown(text("inferred")).alias("non_skip"),
        shown(text("tag_strings")).alias("tags"),
        shown(F.when(F.col("inferred_per_s").isNotNull(), fixed("inferred_per_s", 4))).alias("inferred_rate"),
        shown(F.when(F.col("tags_per_s").isNotNull(), fixed("tags_per_s", 4))).alias("tags_rate"),
        shown(F.concat_ws("/", "outcome", "status")).alias("outcome"),
    )

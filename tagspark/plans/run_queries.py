"""Named queries: run analytics and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagspark.functions import loglines, numbers
from tagspark.functions.loglines import DIGEST_TEXTS, DIGEST_WORDS
from tagspark.operators import metrics, sessions
from tagspark.operators.snapshot import session_snapshot
from tagspark.plans.library import Library
from tagspark.plans.registry import part, query

BATCH_BOUNDS, PARALLEL_BOUNDS, INTRA_BOUNDS = (8, 64), (2, 2), (1, 4)
HISTORY = 5

# ---- run analytics ---------------------------------------------------------------------------
_D = "CAST({} AS DECIMAL(18, 6))"
part(
    "session_sums",
    f"""SELECT session_id, count(*) AS n, CAST(sum({_D.format('fetch_s')}) AS DOUBLE) AS f, CAST(sum({_D.format('predict_s')}) AS DOUBLE) AS p,
    CAST(sum({_D.format('apply_s')}) AS DOUBLE) AS a,
    CAST(sum({_D.format('fetch_s')} + {_D.format('predict_s')} + {_D.format('apply_s')}) AS DOUBLE) AS w FROM batch_metrics GROUP BY session_id""",
    "batch_metrics",
)


@query(
    "sessions",
    "session_sums",
    sql="""SELECT s.session_id, stopped, batches AS batches_completed, n AS batches_recorded, processed AS total_processed,
    round(f, 4) AS sum_fetch_s, round(p, 4) AS sum_predict_s, round(a, 4) AS sum_apply_s, round(w, 4) AS sum_wall_s,
    round(f / n, 4) AS avg_fetch_s, round(p / n, 4) AS avg_predict_s, round(a / n, 4) AS avg_apply_s,
    CASE WHEN w > 0 THEN round(processed / w, 4) END AS files_per_wall_s FROM sessions s JOIN session_sums t ON s.session_id = t.session_id""",
)
def tuning_report(lib: Library) -> DataFrame:
    return metrics.tuning_report(lib.batch_metrics, lib.sessions)


@query(
    "batch_metrics",
    sql="""SELECT session_id, CAST(floor((batch_index - 1) / 16) AS BIGINT) AS part, count(*) AS batches,
    string_agg(CAST(batch_index AS STRING), ',' ORDER BY batch_index) AS indices FROM batch_metrics GROUP BY 1, 2""",
)
def tuning_series(lib: Library) -> DataFrame:
    series = metrics.tuning_series(lib.batch_metrics, 16)
    indices = F.transform("batch_series", lambda b: b["batch_index"].cast("string"))
    return series.select(
        "session_id", "part", F.size("batch_series").cast("bigint").alias("batches"), F.array_join(indices, ",").alias("indices")
    )


@query(
    "batch_metrics",
    sql="""SELECT session_id, batch_index, round(apply_s, 4) AS apply_s, CAST(effective_batch AS INT) AS effective_batch,
    CAST(download_parallel AS INT) AS download_parallel, round(fetch_s * 1000.0, 2) AS peak_rss_mb,
    CAST(NULL AS INT) AS intra_threads FROM batch_metrics""",
)
def metric_rows(lib: Library) -> DataFrame:
    sampled = lib.batch_metrics.withColumn("peak_rss_mb", F.col("fetch_s") * 1000.0)
    return metrics.metric_row(sampled).select(
        "session_id", "batch_index", "apply_s", "effective_batch", "download_parallel", "peak_rss_mb", "intra_threads"
    )


part(
    "phases",
    """SELECT *, CASE WHEN batch_index <= 3 THEN 'warm_up' WHEN batch_index <= 6 THEN 'explore_bs' WHEN batch_index <= 7 THEN 'explore_dlp'
      WHEN batch_index <= 10 THEN 'explore_intra' ELSE 'hold' END AS phase,
    CASE WHEN batch_index <= 3 THEN batch_index WHEN batch_index <= 6 THEN batch_index - 3 WHEN batch_index <= 7 THEN batch_index - 6
      WHEN batch_index <= 10 THEN batch_index - 7 ELSE batch_index - 10 END AS trial,
    CASE batch_index WHEN 4 THEN 8 WHEN 5 THEN 36 WHEN 6 THEN 64 WHEN 7 THEN 2 WHEN 8 THEN 1 WHEN 9 THEN 2 WHEN 10 THEN 4 END AS candidate,
    least(batch_index, 10) AS search_done, 10 AS search_total, fetch_s + predict_s + apply_s AS wall FROM batch_metrics""",
    "batch_metrics",
)


def labelled(lib: Library) -> DataFrame:
    return metrics.label_phases(lib.batch_metrics, BATCH_BOUNDS, PARALLEL_BOUNDS, INTRA_BOUNDS)


@query(
    "phases",
    sql="""SELECT session_id, batch_index, phase, CAST(trial AS INT) AS trial, candidate, CAST(search_done AS INT) AS search_done, search_total
    FROM phases""",
)
def phase_labels(lib: Library) -> DataFrame:
    return labelled(lib).select(
        "session_id", "batch_index", "phase", "trial", "candidate", "search_done", "search_total"
    )


@query(
    "phases",
    sql="""SELECT session_id, phase, candidate AS best, score, trials FROM (SELECT *, count(*) OVER (PARTITION BY session_id, phase) AS trials,
    row_number() OVER (PARTITION BY session_id, phase ORDER BY score DESC, trial) AS r FROM
      (SELECT *, CASE WHEN wall > 0 THEN coalesce(nullif(files_in_batch, 0), nullif(predict_queue, 0), 0) / wall ELSE 0 END AS score
       FROM phases WHERE phase LIKE 'explore%')) WHERE r = 1""",
)
def best_knobs(lib: Library) -> DataFrame:
    return metrics.best_knobs(labelled(lib))


@query(
    "batch_metrics",
    sql="""SELECT session_id, batch_index, count(*) OVER w AS batches, CAST(sum(files_in_batch) OVER w AS BIGINT) AS files,
    string_agg(CAST(effective_batch AS STRING), ',') OVER w AS sizes FROM batch_metrics
    WINDOW w AS (PARTITION BY session_id ORDER BY batch_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def rolling_history(lib: Library) -> DataFrame:
    rows = metrics.rolling_history(lib.batch_metrics, HISTORY)
    files = F.aggregate("history", F.lit(0).cast("bigint"), lambda total, b: total + b["files_in_batch"])
    sizes = F.transform("history", lambda b: b["effective_batch"].cast("string"))
    return rows.select(
        "session_id",
        "batch_index",
        F.size("history").cast("bigint").alias("batches"),
        files.alias("files"),
        F.array_join(sizes, ",").alias("sizes"),
    )


@query(
    "phases",
    sql="""SELECT session_id, batch_index, phase, CASE WHEN m <> 0 THEN round(m, 4) END AS avg_batch_wall_s,
    CASE WHEN search_done < search_total THEN round(m * (search_total - search_done), 1) END AS eta_s FROM
    (SELECT *, avg(wall) OVER (PARTITION BY session_id ORDER BY batch_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM phases)""",
)
def tuning_eta(lib: Library) -> DataFrame:
    return metrics.tuning_eta(labelled(lib))


part(
    "recent_runs",
    """SELECT *, row_number() OVER (PARTITION BY model ORDER BY saved_at DESC, run_id DESC) AS n FROM tuning_runs""",
    "tuning_runs",
)


@query(
    "recent_runs",
    sql="""SELECT a.model, a.saved_at AS last_saved_at, a.batch_size AS last_batch_size, a.download_parallel AS last_download_parallel,
    b.saved_at AS previous_saved_at, b.batch_size AS previous_batch_size, b.download_parallel AS previous_download_parallel
    FROM recent_runs a LEFT JOIN recent_runs b ON a.model = b.model AND b.n = 2 WHERE a.n = 1""",
)
def latest_tunings(lib: Library) -> DataFrame:
    return metrics.latest_two_tunings(lib.tuning_runs)


@query(
    "sessions",
    sql="""SELECT count(*) FILTER (WHERE NOT r) AS tagging_sessions, count(*) FILTER (WHERE r) AS validation_rejects,
    CAST(coalesce(sum(greatest(0, processed)) FILTER (WHERE NOT r), 0) AS BIGINT) AS files_processed,
    CAST(coalesce(sum(greatest(0, batches)) FILTER (WHERE NOT r), 0) AS BIGINT) AS outer_batches
    FROM (SELECT *, outcome IN ('empty_queue', 'invalid_request') AS r FROM sessions)""",
)
def process_totals(lib: Library) -> DataFrame:
    return metrics.process_totals(lib.sessions)


@query(
    "sessions",
    sql="""SELECT session_id, CASE WHEN outcome = 'error' THEN 'error' WHEN outcome IN ('empty_queue', 'invalid_request') THEN 'skipped'
    WHEN stopped THEN 'stopped' ELSE 'complete' END AS status FROM sessions""",
)
def outcome_status(lib: Library) -> DataFrame:
    return lib.sessions.select("session_id", numbers.outcome_status("outcome", "stopped").alias("status"))


@query(
    "batch_metrics",
    sql="""SELECT session_id, batch_index, CASE WHEN e >= 0.35 THEN files_in_batch / e END AS files_per_s,
    CASE WHEN e >= 0.35 THEN predict_queue / e END AS tags_per_s
    FROM (SELECT *, fetch_s + predict_s + apply_s AS e FROM batch_metrics)""",
)
def throughput(lib: Library) -> DataFrame:
    wall = numbers.batch_wall("fetch_s", "predict_s", "apply_s")
    rates = numbers.throughput(wall, "files_in_batch", "predict_queue")
    return lib.batch_metrics.select(
        "session_id", "batch_index", rates["files_per_s"].alias("files_per_s"), rates["tags_per_s"].alias("tags_per_s")
    )


@query(
    "batch_metrics",
    sql="""SELECT session_id, same AS skipped_same, higher AS skipped_higher, dup AS duplicates_skipped, stale AS stale_removed, files AS files_processed,
    tags AS tags_applied, greatest(0, files - same - higher) AS inferred_non_skip,
    CASE WHEN w > 0 THEN round(greatest(0, files - same - higher) / w, 4) ELSE 0 END AS inferred_per_s,
    CASE WHEN w > 0 THEN round(tags / w, 4) ELSE 0 END AS tags_per_s FROM
    (SELECT session_id, CAST(sum(predict_queue) AS BIGINT) AS same, CAST(sum(batch_index % 2) AS BIGINT) AS higher,
      CAST(sum(batch_index % 3) AS BIGINT) AS dup, CAST(sum(batch_index % 4) AS BIGINT) AS stale, CAST(sum(files_in_batch) AS BIGINT) AS files,
      CAST(sum(files_in_batch * 2) AS BIGINT) AS tags, CAST(sum(CAST(fetch_s + predict_s AS DECIMAL(18, 6))) AS DOUBLE) AS w
     FROM batch_metrics GROUP BY session_id)""",
)
def session_metrics(lib: Library) -> DataFrame:
    rows = lib.batch_metrics
    i = F.col("batch_index")
    batches = rows.select(
        "session_id",
        F.col("predict_queue").alias("skipped_same"),
        (i % 2).alias("skipped_higher"),
        (i % 4).alias("stale_removed"),
        F.col("files_in_batch").alias("processed"),
    )
    writes = rows.groupBy("session_id").agg(
        F.sum(i % 3).alias("duplicates_skipped"), F.sum(F.col("files_in_batch") * 2).alias("new_tag_strings")
    )
    wall = F.sum((F.col("fetch_s") + F.col("predict_s")).cast("decimal(18,6)")).cast("double")
    walls = rows.groupBy("session_id").agg(wall.alias("wall_s"))
    return metrics.session_metrics(batches, ["session_id"], writes, walls)


# ---- session events --------------------------------------------------------------------------
SNAPSHOT_KEYS = ("current", "queue_total", "pending_remaining", "total_applied", "pending_hydrus_queue", "batches_completed")


def event_rows(events: DataFrame) -> DataFrame:
    """Events that offer every key; which one may set it depends on the event."""
    offered = [F.col("k").alias(key) for key in SNAPSHOT_KEYS]
    return events.select("session_id", "seq", "ts", "type", F.concat(F.lit("m"), F.col("k").cast("string")).alias("message"), *offered)


def _latest(kinds: tuple[str, ...], value: str = "k") -> str:
    listed = ", ".join(f"'{kind}'" for kind in kinds)
    return f"arg_max({value}, seq) FILTER (WHERE type IN ({listed}))"


_SNAPSHOT = f"""SELECT session_id, max(seq) AS last_seq, arg_max(ts, seq) AS updated_at,
    arg_max(CASE WHEN type IN ('stopping', 'server_shutting_down') THEN 'stopping' WHEN type IN ('complete', 'stopped') THEN 'finishing'
      ELSE 'tagging' END, seq) AS phase,
    {_latest(('stopping', 'server_shutting_down'), "CASE type WHEN 'stopping' THEN 'user' ELSE 'server' END")} AS stopping_source,
    {_latest(('stopping', 'server_shutting_down'), "'m' || CAST(k AS STRING)")} AS detail,
    {_latest(('progress', 'file'))} AS current, {_latest(('queue_plan',))} AS queue_total,
    {_latest(('tags_applied',))} AS pending_remaining, {_latest(('progress', 'file', 'tags_applied', 'complete', 'stopped'))} AS total_applied,
    {_latest(('stopping',))} AS pending_hydrus_queue, {_latest(('progress', 'file', 'complete', 'stopped'))} AS batches_completed
    FROM """
SNAPSHOT_SQL = f"{_SNAPSHOT} session_events GROUP BY session_id"

# Events after the last pause of more than 15 minutes of their session.
part(
    "paused_events",
    """SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts) > INTERVAL 15 MINUTE THEN ts END AS began
    FROM session_events""",
    "session_events",
)
part(
    "live_events",
    """SELECT * FROM (SELECT *, max(began) OVER (PARTITION BY session_id) AS last FROM paused_events)
    WHERE last IS NULL OR ts >= last""",
    "paused_events",
)
LIVE_SNAPSHOT_SQL = f"{_SNAPSHOT} live_events GROUP BY session_id"


@query("session_events", sql=SNAPSHOT_SQL)
def latest_session_state(lib: Library) -> DataFrame:
    return session_snapshot(event_rows(lib.session_events), SNAPSHOT_KEYS)


# ---- run logs --------------------------------------------------------------------------------
def _digest_columns() -> str:
    parts = ["count(*) AS lines"]
    for name, needles in DIGEST_TEXTS.items():
        hit = " OR ".join(f"contains(line, '{needle}')" for needle in needles)
        parts.append(f"count(*) FILTER (WHERE {hit}) AS {name}")
    for name, word in DIGEST_WORDS.items():
        parts.append(f"count(*) FILTER (WHERE regexp_matches(line, '\\b{word}\\b')) AS {name}")
    return ", ".join(parts)


DIGEST_SQL = _digest_columns()


@query("log_lines", sql=f"SELECT run_id, {DIGEST_SQL} FROM log_lines GROUP BY run_id")
def log_digest(lib: Library) -> DataFrame:
    return sessions.log_digest(lib.log_lines)


@query(
    "log_lines",
    sql="""SELECT run_id, CAST(n AS INT) AS n, substr(trim(line), 1, 500) AS line FROM (SELECT *, row_number() OVER
    (PARTITION BY run_id ORDER BY line_no) AS n FROM log_lines WHERE contains(line, ' ERROR [')) WHERE n <= 8""",
)
def sample_errors(lib: Library) -> DataFrame:
    return sessions.sample_errors(lib.log_lines)


def _x(pattern: str, group: int, kind: str, line: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({line}, '{pattern}', {group}), '') AS {kind})"


def _field(key: str) -> str:
    """Pattern of one field's value, whatever stands around it; `key/` is what follows its slash."""
    return f" {key[:-1]}=[^ /]*/([^ ]*)" if key.endswith("/") else f" {key}=([^ /]*)"


_CF = {
    "config_batch": _field("config_inference_batch_saved"),
    "config_apply_every": _field("apply_tags_every_n_effective"),
    "config_intra": _field("ort_cpu_threads_intra_inter"),
    "config_inter": _field("ort_cpu_threads_intra_inter/"),
}
part(
    "log_starts",
    "SELECT run_id, line_no AS start_line, line AS start_text, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS session "
    "FROM log_lines WHERE contains(line, 'tagging_ws metadata_prefetch')",
    "log_lines",
)
part(
    "log_ends",
    "SELECT run_id, line_no AS end_line, line AS end_text, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS session "
    "FROM log_lines WHERE contains(line, 'perf tagging_session') AND contains(line, 'wall_s=')",
    "log_lines",
)
part(
    "log_pairs",
    "SELECT s.*, e.end_line, e.end_text FROM log_starts s LEFT JOIN log_ends e ON s.run_id = e.run_id AND s.session = e.session",
    "log_starts",
    "log_ends",
)
# The next end line after the start instead.
part(
    "log_next_pairs",
    """SELECT s.*, e.end_line, e.end_text FROM log_starts s LEFT JOIN
    (SELECT s.run_id, s.session, min(e.end_line) AS first_end FROM log_starts s JOIN log_ends e ON s.run_id = e.run_id AND e.end_line > s.start_line
     GROUP BY s.run_id, s.session) f ON s.run_id = f.run_id AND s.session = f.session
    LEFT JOIN log_ends e ON e.run_id = f.run_id AND e.end_line = f.first_end""",
    "log_starts",
    "log_ends",
)


def _members(pairs: str) -> str:
    """Sums over the lines of each session by an interval join."""
    return f"""SELECT p.run_id, p.session,
    round(coalesce(sum({_x('wall_onnx_predict_s=([0-9.]+)', 1, 'DECIMAL(18, 6)', 'l.line')}), 0), 3) AS sum_predict_s,
    round(coalesce(sum({_x('wall_hydrus_fetch_s=([0-9.]+)', 1, 'DECIMAL(18, 6)', 'l.line')}), 0), 3) AS sum_fetch_s,
    coalesce(sum({_x('skipped_pre_infer_marker_files=([0-9]+)', 1, 'BIGINT', 'l.line')}), 0) AS sum_skipped_files,
    coalesce(sum({_x('inferred_files=([0-9]+)', 1, 'BIGINT', 'l.line')}), 0) AS sum_inferred_files
    FROM {pairs} p LEFT JOIN log_lines l ON l.run_id = p.run_id AND l.line_no >= p.start_line
      AND (p.end_line IS NULL OR l.line_no <= p.end_line)
      AND contains(l.line, 'tag_files metrics') AND contains(l.line, 'wall_onnx_predict_s=') GROUP BY p.run_id, p.session"""


def _lookup(pairs: str, mark: str, condition: str, pick: str) -> str:
    return f"""SELECT p.run_id, p.session, {pick}(l.line, l.line_no) AS text FROM {pairs} p JOIN log_lines l
    ON l.run_id = p.run_id AND contains(l.line, '{mark}') AND {condition} GROUP BY p.run_id, p.session"""


def _sessions_sql(pairs: str) -> str:
    fields = [
        f"coalesce({_x(_field('wall_s'), 1, 'DOUBLE', 'start_text')}, 0) AS prefetch_s",
        f"coalesce({_x(_field('rows'), 1, 'BIGINT', 'start_text')}, 0) AS prefetch_rows",
    ]
    # column, type and key in the line
    shapes = {
        "end_text": "wall_s:DOUBLE:wall_s model_prepare_s:DOUBLE:model_prepare_s processed:BIGINT:processed batches:BIGINT:outer_batches "
        "written_files:BIGINT:hydrus_files tag_strings:BIGINT:tag_strings outcome:STRING:outcome status:STRING:outcome/ model:STRING:model",
        "sm.text": "skipped_same:BIGINT:onnx_skipped_same_marker skipped_higher:BIGINT:onnx_skipped_higher_tier_marker "
        "files_processed:BIGINT:files_processed tags_applied:BIGINT:tags_new_strings_applied",
        "rt.text": "rates_wall_s:DOUBLE:wall_s inferred:BIGINT:inferred_non_skip inferred_per_s:DOUBLE:inferred_non_skip_per_s "
        "tags_per_s:DOUBLE:tags_new_strings_per_s rates_batches:BIGINT:outer_batches",
        "qa.text": "infer:BIGINT:infer skip_same:BIGINT:skip_same_marker skip_higher:BIGINT:skip_higher_tier missing:BIGINT:missing_metadata",
    }
    for line, specs in shapes.items():
        for spec in specs.split():
            name, kind, key = spec.split(":")
            fields.append(f"{_x(_field(key), 1, kind, line)} AS {name}")
    complete = " AND ".join(f"regexp_matches(cf.text, '{p}')" for p in _CF.values())
    for name, pattern in _CF.items():
        fields.append(f"CASE WHEN {complete} THEN {_x(pattern, 1, 'BIGINT', 'cf.text')} END AS {name}")
    upto = "(p.end_line IS NULL OR l.line_no <= p.end_line)"
    lookups = {
        "sm": ("tagging_ws session_metrics", "l.line_no > greatest(p.start_line, p.end_line - 8) AND l.line_no <= p.end_line", "arg_max"),
        "rt": ("session_perf_rates", "l.line_no >= p.end_line AND l.line_no < p.end_line + 5", "arg_min"),
        "qa": ("tagging_ws queue_analysis", f"l.line_no >= p.start_line AND {upto}", "arg_min"),
        "cf": ("tagging_ws session_config", "l.line_no >= p.start_line - 40 AND l.line_no <= p.start_line", "arg_min"),
    }
    joins = " ".join(
        f"LEFT JOIN ({_lookup(pairs, *spec)}) {name} ON {name}.run_id = p.run_id AND {name}.session = p.session"
        for name, spec in lookups.items()
    )
    return f"""SELECT p.run_id, p.session, p.start_line, p.end_line, CAST(m.sum_predict_s AS DOUBLE) AS sum_predict_s,
    CAST(m.sum_fetch_s AS DOUBLE) AS sum_fetch_s, CAST(m.sum_skipped_files AS BIGINT) AS sum_skipped_files,
    CAST(m.sum_inferred_files AS BIGINT) AS sum_inferred_files, {", ".join(fields)} FROM {pairs} p
    JOIN ({_members(pairs)}) m ON m.run_id = p.run_id AND m.session = p.session {joins}"""


part("log_table", _sessions_sql("log_pairs"), "log_pairs")


@query("log_table", sql="SELECT * FROM log_table")
def log_sessions(lib: Library) -> DataFrame:
    return sessions.parse_sessions(lib.log_lines)


@query("log_next_pairs", sql=_sessions_sql("log_next_pairs"))
def log_sessions_next(lib: Library) -> DataFrame:
    return sessions.parse_sessions(lib.log_lines, pairing="next")


@query(
    "log_table",
    sql="SELECT run_id, session, sum_predict_s, sum_fetch_s, sum_skipped_files, sum_inferred_files FROM log_table",
)
def log_session_sums(lib: Library) -> DataFrame:
    return sessions.session_sums(sessions.parse_sessions(lib.log_lines))


def _shown(value: str) -> str:
    return f"CASE WHEN wall_s IS NULL THEN '' ELSE coalesce({value}, '—') END"


@query(
    "log_table",
    sql=f"""SELECT run_id, session AS run, CASE WHEN config_batch IS NULL THEN '' ELSE
      concat_ws('/', config_batch, config_apply_every, config_intra, config_inter) END AS config,
    CASE WHEN wall_s IS NULL THEN '…' ELSE format('{{:.3f}}', prefetch_s) END AS prefetch,
    CASE WHEN wall_s IS NULL THEN '(no perf line in segment)' ELSE format('{{:.3f}}', wall_s) END AS wall,
    {_shown("CAST(sum_predict_s AS STRING)")} AS predict, {_shown("format('{:.3f}', sum_fetch_s)")} AS fetch,
    {_shown("CAST(batches AS STRING)")} AS batches, {_shown("CAST(processed AS STRING)")} AS processed,
    {_shown("CAST(skipped_same AS STRING)")} AS skip_same, {_shown("CAST(inferred AS STRING)")} AS non_skip,
    {_shown("CAST(tag_strings AS STRING)")} AS tags, {_shown("format('{:.4f}', inferred_per_s)")} AS inferred_rate,
    {_shown("format('{:.4f}', tags_per_s)")} AS tags_rate, {_shown("outcome || '/' || status")} AS outcome FROM log_table""",
)
def session_report(lib: Library) -> DataFrame:
    return sessions.session_report(sessions.parse_sessions(lib.log_lines))


@query(
    "log_lines",
    sql="""SELECT run_id, line_no, CAST(substr(line, 1, 19) AS TIMESTAMP) AS ts, split_part(substr(line, 21), ' ', 1) AS level,
    'r' AS run, regexp_extract(line, '\\[r\\] \\[([a-z]+)\\]', 1) AS logger, regexp_extract(line, '\\[r\\] \\[[a-z]+\\] (.*)', 1) AS message
    FROM log_lines""",
)
def log_fields(lib: Library) -> DataFrame:
    f = loglines.log_fields("line")
    return lib.log_lines.select(
        "run_id", "line_no", f["ts"].alias("ts"), f["level"].alias("level"), f["run_id"].alias("run"),
        f["logger"].alias("logger"), f["message"].alias("message"),
    )


@query(
    "log_lines",
    sql=f"""SELECT run_id, line_no, {_x('wall_onnx_predict_s=([0-9.]+)', 1, 'DOUBLE', 'line')} AS predict_s,
    {_x('wall_hydrus_fetch_s=([0-9.]+)', 1, 'DOUBLE', 'line')} AS fetch_s,
    {_x('skipped_pre_infer_marker_files=([0-9]+)', 1, 'BIGINT', 'line')} AS skipped_files,
    {_x('inferred_files=([0-9]+)', 1, 'BIGINT', 'line')} AS inferred_files FROM log_lines WHERE contains(line, 'tag_files metrics')""",
)
def metrics_lines(lib: Library) -> DataFrame:
    rec = loglines.metrics_record("line")
    found = lib.log_lines.where(F.contains("line", F.lit("tag_files metrics")))
    return found.select(
        "run_id",
        "line_no",
        rec["predict_s"].cast("double").alias("predict_s"),
        rec["fetch_s"].cast("double").alias("fetch_s"),
        rec["skipped_files"].alias("skipped_files"),
        rec["inferred_files"].alias("inferred_files"),
    )


@query(
    "sessions",
    sql="""SELECT session_id, 'stats op=tagging_session batches=' || CAST(batches AS STRING) || ' label=''s ' || CAST(session_id AS STRING)
    || ''' none= outcome=' || outcome || ' stopped=' || CASE WHEN stopped THEN 'true' ELSE 'false' END || ' wall_s='
    || CASE session_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '0.25' WHEN 2 THEN '0.5' ELSE '0.75' END AS line FROM sessions""",
)
def stats_lines(lib: Library) -> DataFrame:
    values = {
        "wall_s": loglines.stats_value((F.col("session_id") % 4) * 0.25, "real"),
        "stopped": loglines.stats_value("stopped", "flag"),
        "outcome": loglines.stats_value("outcome", "text"),
        "label": loglines.stats_value(F.concat(F.lit("s "), F.col("session_id").cast("string")), "text"),
        "batches": loglines.stats_value("batches", "integer"),
        "none": loglines.stats_value(F.lit(None).cast("string"), "text"),
    }
    return lib.sessions.select("session_id", loglines.stats_line(F.lit("tagging_session"), values).alias("line"))


@query(
    "log_lines",
    sql="""SELECT run_id, line_no, 'tagging_session' AS op, 'a b' AS label, 'ok' AS outcome, regexp_extract(line, 'processed=([0-9]+)', 1) AS processed,
    regexp_extract(line, 'wall_s=([0-9]+)', 1) AS wall_s FROM log_lines WHERE contains(line, 'stats op=')""",
)
def parsed_stats(lib: Library) -> DataFrame:
    rows = lib.log_lines.select("run_id", "line_no", loglines.parse_stats_line("line").alias("m")).where("m IS NOT NULL")
    return rows.select("run_id", "line_no", *[F.col("m")[k].alias(k) for k in ("op", "label", "outcome", "processed", "wall_s")])


@query(
    "log_lines",
    sql="""SELECT run_id, modified_at FROM (SELECT run_id, CAST(substr(line, 1, 19) AS TIMESTAMP) AS modified_at FROM log_lines)
    ORDER BY modified_at DESC, run_id DESC LIMIT 1""",
)
def latest_run(lib: Library) -> DataFrame:
    stamped = lib.log_lines.withColumn("modified_at", loglines.log_fields("line")["ts"])
    return sessions.latest_run(stamped)


@query(
    "log_lines",
    sql="""SELECT run_id, rtrim(arg_max(line, line_no)) AS shutdown FROM log_lines WHERE contains(line, 'perf process_shutdown') GROUP BY run_id""",
)
def log_shutdowns(lib: Library) -> DataFrame:
    return sessions.last_shutdown(lib.log_lines)

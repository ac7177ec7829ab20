"""Run-log lines: prefix fields, metrics, session records, `stats` key-value lines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from tagspark.functions.text import _col

# ---- fixed values: the text of run logs ----------------------------------------------------
LOG_PREFIX = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) (\S+) \[([^\]]*)\] \[([^\]]*)\] (.*)$"

ERROR_MARK = " ERROR ["
WARNING_MARK = " WARNING ["
PREFETCH_MARK = "tagging_ws metadata_prefetch"
QUEUE_MARK = "tagging_ws queue_analysis"
METRICS_MARK = "tagging_ws session_metrics"
RATES_MARK = "session_perf_rates"
CONFIG_MARK = "tagging_ws session_config"
PERF_MARK = "perf tagging_session"
SHUTDOWN_MARK = "perf process_shutdown"
SCORING_MARK = "tag_files metrics"
SCORING_WALL_MARK = "wall_onnx_predict_s="
# any of the marks that make up a session
SESSION_LINES = "|".join(
    (PREFETCH_MARK, PERF_MARK, QUEUE_MARK, METRICS_MARK, RATES_MARK, CONFIG_MARK, SCORING_MARK)
)

# digest counter -> texts, any of which counts the line once
DIGEST_TEXTS = {
    "error_count": (" ERROR [",),
    "warning_count": (" WARNING [",),
    "disk_cache_miss_lines": ("disk cache miss",),
    "disk_cache_invalid_lines": ("disk_cache_invalid",),
    "tag_files_metadata_fetched": (
        "tag_files metadata_fetched",
        "tag_files metadata rows=",
        "tagging_ws metadata_prefetch",
    ),
    "files_metadata_fetched": ("files metadata_hydrus", "stats op=hydrus_metadata_fetch"),
    "application_ready_lines": ("Application ready host=",),
}
# digest counter -> text that must stand between word boundaries
DIGEST_WORDS = {
    "memory_cache_hit_true": "memory_cache_hit=True",
    "memory_cache_hit_false": "memory_cache_hit=False",
    "disk_cache_hit_true": "disk_cache_hit=True",
    "disk_cache_hit_false": "disk_cache_hit=False",
    "disk_cache_hit_na": "disk_cache_hit=n/a",
    "hub_fetch_true": "hub_fetch_this_call=True",
    "hub_fetch_false": "hub_fetch_this_call=False",
}

# Names of fields, in the kinds of lines that have all of them: column -> key, type, and the part
# of a value that a slash divides.
PREFETCH = {
    "prefetch_s": ("wall_s", "decimal(18,3)", 0),
    "prefetch_rows": ("rows", "bigint", 0),
    "prefetch_ids": ("file_ids", "bigint", 0),
}
QUEUE = {
    "infer": ("infer", "bigint", 0),
    "skip_same": ("skip_same_marker", "bigint", 0),
    "skip_higher": ("skip_higher_tier", "bigint", 0),
    "missing": ("missing_metadata", "bigint", 0),
}
SESSION_METRICS = {
    "skipped_same": ("onnx_skipped_same_marker", "bigint", 0),
    "skipped_higher": ("onnx_skipped_higher_tier_marker", "bigint", 0),
    "files_processed": ("files_processed", "bigint", 0),
    "tags_applied": ("tags_new_strings_applied", "bigint", 0),
}
RATES = {
    "rates_wall_s": ("wall_s", "decimal(18,3)", 0),
    "inferred": ("inferred_non_skip", "bigint", 0),
    "inferred_per_s": ("inferred_non_skip_per_s", "decimal(18,4)", 0),
    "tags_per_s": ("tags_new_strings_per_s", "decimal(18,4)", 0),
    "rates_batches": ("outer_batches", "bigint", 0),
}
PERF = {
    "wall_s": ("wall_s", "decimal(18,3)", 0),
    "model_prepare_s": ("model_prepare_s", "decimal(18,3)", 0),
    "processed": ("processed", "bigint", 0),
    "batches": ("outer_batches", "bigint", 0),
    "written_files": ("hydrus_files", "bigint", 0),
    "tag_strings": ("tag_strings", "bigint", 0),
    "outcome": ("outcome", "string", 1),
    "status": ("outcome", "string", 2),
    "model": ("model", "string", 0),
}
CONFIG_FIELDS = {
    "config_batch": ("config_inference_batch_saved", "bigint", 0),
    "config_apply_every": ("apply_tags_every_n_effective", "bigint", 0),
    "config_intra": ("ort_cpu_threads_intra_inter", "bigint", 1),
    "config_inter": ("ort_cpu_threads_intra_inter", "bigint", 2),
}
# Scoring lines may lack any of theirs.
SCORING_FIELDS = {
    "predict_s": ("wall_onnx_predict_s", "decimal(18,6)", 0),
    "fetch_s": ("wall_hydrus_fetch_s", "decimal(18,6)", 0),
    "skipped_files": ("skipped_pre_infer_marker_files", "bigint", 0),
    "inferred_files": ("inferred_files", "bigint", 0),
}
STATS_PAIR = r"""(\w+)=('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\S*)"""

# Every character at which a line ends besides the usual newline forms.
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _group(line: Column, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, index), F.lit(""))


def log_fields(line: Column | str) -> Column:
    """struct(ts, level, run_id, logger, message); all null when the line has no log prefix."""
    text = _col(line)
    return F.struct(
        F.try_to_timestamp(_group(text, LOG_PREFIX, 1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
        _group(text, LOG_PREFIX, 2).alias("level"),
        _group(text, LOG_PREFIX, 3).alias("run_id"),
        _group(text, LOG_PREFIX, 4).alias("logger"),
        _group(text, LOG_PREFIX, 5).alias("message"),
    )


def read_fields(line: Column | str, fields: Mapping[str, tuple[str, str, int]]) -> Column:
    """struct of typed values of `key=value` words of a line; null where a key is not there or its value has another type.

    The line is cut into words once and each key is looked up among them; the first of equal keys
    counts. Commas and semicolons after a value do not belong to it.
    """

    def value(words: Column, keys: Column, key: str, kind: str, part: int) -> Column:
        word = F.get(words, (F.array_position(keys, F.lit(key)) - 1).cast("int"))
        text = F.rtrim(F.substring(word, len(key) + 2, 2_147_483_647), F.lit(",;"))
        if part:
            text = F.split_part(text, F.lit("/"), F.lit(part))
        return F.nullif(text, F.lit("")).try_cast(kind)

    def struct(words: Column, keys: Column) -> Column:
        return F.struct(*[value(words, keys, *field).alias(name) for name, field in fields.items()])

    # One-element arrays, so that words and keys are computed once and not for every field.
    def named(words: Column) -> Column:
        keys = F.transform(words, lambda word: F.substring_index(word, "=", 1))
        return F.transform(F.array(keys), lambda found: struct(words, found))[0]

    return F.transform(F.array(F.split(_col(line), " ")), named)[0]


def record(line: Column | str, fields: Mapping[str, tuple[str, str, int]]) -> Column:
    """One struct per line kind; null unless the line has all fields of its kind."""
    found = read_fields(line, fields)
    whole = F.lit(True)
    for name in fields:
        whole = whole & found[name].isNotNull()
    return F.when(whole, found)


def config_record(line: Column | str) -> Column:
    """struct of the four saved settings, or null when one of them is missing."""
    return record(line, CONFIG_FIELDS)


def metrics_record(line: Column | str) -> Column:
    """Scoring metrics of one line; a missing field is null."""
    return read_fields(line, SCORING_FIELDS)


def digest_counters(line: Column | str) -> dict[str, Column]:
    """Digest counter name -> does this line count. A line may count for several."""
    text = _col(line)
    hits = {}
    for name, needles in DIGEST_TEXTS.items():
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.contains(text, F.lit(needle))
        hits[name] = hit
    for name, word in DIGEST_WORDS.items():
        # The pattern runs only on lines that hold the text at all.
        hits[name] = F.contains(text, F.lit(word)) & F.rlike(text, F.lit(rf"\b{word}\b"))
    return hits


def _quoted(text: Column) -> Column:
    """Text in quotes the way a Python literal shows it."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t"))
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    return F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def stats_value(value: Column | str, kind: str) -> Column:
    """One value of a stats line; `kind` is text, integer, real or flag."""
    v = _col(value)
    if kind == "flag":
        shown = F.when(v, F.lit("true")).otherwise(F.lit("false"))
    elif kind == "integer":
        shown = v.cast("string")
    elif kind == "real":
        plain = F.regexp_replace(F.format_string("%.6f", v.cast("double")), r"\.?0+$", "")
        d = v.cast("double")
        shown = (
            F.when(F.isnan(d), F.lit("nan"))
            .when(d == float("inf"), F.lit("inf"))
            .when(d == float("-inf"), F.lit("-inf"))
            .otherwise(plain)
        )
    else:
        flat = F.translate(v, "\n\r", "  ")
        special = F.contains(flat, F.lit(" ")) | F.contains(flat, F.lit("=")) | F.contains(flat, F.lit('"'))
        shown = F.when(special, _quoted(flat)).otherwise(flat)
    return F.when(v.isNull(), F.lit("")).otherwise(shown)


def stats_line(op: Column | str, values: Mapping[str, Column]) -> Column:
    """`stats op=<op> k=v ...` with keys in sorted order; values come from `stats_value`."""
    parts = [F.concat(F.lit(f"{key}="), values[key]) for key in sorted(values)]
    return F.concat_ws(" ", F.concat(F.lit("stats op="), _col(op)), *parts)


def parse_stats_line(line: Column | str) -> Column:
    """Key-value map of a stats line (`op` included), null for any other line."""
    text = F.regexp_extract(_col(line), r"stats (op=.*)$", 1)
    keys = F.regexp_extract_all(text, F.lit(STATS_PAIR), F.lit(1))
    raw = F.regexp_extract_all(text, F.lit(STATS_PAIR), F.lit(2))
    values = F.transform(
        raw,
        lambda v: F.when(
            F.rlike(v, F.lit(r"""^(['"]).*\1$""")),
            F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), r"\\(.)", "$1"),
        ).otherwise(v),
    )
    unique = F.array_distinct(keys)
    last = F.transform(
        unique,
        lambda k: F.element_at(
            values, (F.size(keys) - F.array_position(F.reverse(keys), k) + 1).cast("int")
        ),
    )
    return F.when(F.length(text) > 0, F.map_from_arrays(unique, last))

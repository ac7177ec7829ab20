"""The tag library as views over the given tables.

One SQL text per view serves Spark and the checking engine. No view sorts, numbers or groups
rows: positions come from columns, so a view costs a scan (and a join to `part` for tag text).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagspark.functions.text import normalize_tag

# Sessions of 40 batches or events, log runs of 500 lines.
SESSION_ROWS = 40
RUN_LINES = 500

# Every seventeenth order has no metadata, so a queue meets files it knows nothing about.
FILES = """
SELECT o_orderkey AS file_id, md5(CAST(o_orderkey AS STRING)) AS hash,
  CAST(floor(o_totalprice) AS BIGINT) AS size,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'video/mp4' WHEN '2-HIGH' THEN ' Image/PNG '
    WHEN '3-MEDIUM' THEN 'image/jpeg' WHEN '5-LOW' THEN 'application/pdf' END AS mime,
  CASE o_orderstatus WHEN 'F' THEN 'archive' ELSE 'inbox' END AS state
FROM {orders} WHERE o_orderkey % 17 <> 0
"""
# File 3 stands in the queue many times.
QUEUE = """
SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 29 = 3 THEN CAST(3 AS BIGINT) ELSE o_orderkey END AS file_id
FROM {orders}
"""
FILE_TAGS = """
SELECT l_orderkey AS file_id, 'svc' || CAST(l_suppkey % 5 AS STRING) AS service_key,
  CASE l_returnflag WHEN 'A' THEN '0' WHEN 'N' THEN '1' ELSE '2' END AS status,
  CAST(l_linenumber AS BIGINT) AS pos,
  CASE WHEN l_partkey % 50 = 0 THEN 'wd14:wd-vit-tagger-v3' WHEN l_partkey % 50 = 10 THEN 'WD14:wd_swinv2_tagger_v3'
    WHEN l_partkey % 50 = 20 THEN 'wd14:wd-vit-large-tagger-v3' WHEN l_partkey % 50 = 30 THEN 'wd14:wd-eva02-large-tagger-v3'
    WHEN l_partkey % 50 = 40 THEN 'wd14:custom-x'
    WHEN l_linenumber % 3 = 0 THEN replace(p_name, ' ', '_') WHEN l_linenumber % 3 = 1 THEN upper(replace(p_name, ' ', '-'))
    ELSE '  ' || p_name || ' ' END AS tag
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""
PROPOSED = """
SELECT l_orderkey AS file_id, CAST(l_linenumber AS BIGINT) AS pos,
  CASE WHEN l_suppkey % 11 = 0 THEN 'wd14:wd-vit-tagger-v3' WHEN l_suppkey % 11 = 1 THEN 'WD14:wd_swinv2_tagger_v3'
    ELSE replace(p_name, ' ', '_') END AS tag
FROM {lineitem} JOIN {part} ON p_partkey = (l_partkey * 3) % (SELECT count(*) FROM {part})
"""
SERVICES = """
SELECT 'svc' || CAST(n_nationkey AS STRING) AS service_key, n_name AS name, n_regionkey AS type, r_name AS type_pretty
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey <> 3
"""
# 64 labels; 60..63 share the names of 20..23.
TAG_LABELS = """
SELECT CAST(p_partkey AS INT) AS label_idx, CAST(1000 + p_partkey AS INT) AS tag_id,
  CASE WHEN p_partkey >= 60 OR p_partkey BETWEEN 20 AND 23 THEN 'twin_label_' ELSE replace(p_name, ' ', '_') || '_' END
    || CAST(CASE WHEN p_partkey >= 60 THEN p_partkey - 40 ELSE p_partkey END AS STRING) AS name,
  CASE WHEN p_partkey < 4 THEN 9 WHEN p_partkey < 14 THEN 4 ELSE 0 END AS category, p_size AS count
FROM {part} WHERE p_partkey < 64
"""
BATCH_METRICS = """
SELECT CAST(floor(event_id / 40) AS BIGINT) AS session_id, event_id % 40 + 1 AS batch_index,
  CAST(event_id * 37 % 900 AS DOUBLE) / CAST(1000 AS DOUBLE) AS fetch_s,
  CAST(event_id * 53 % 1900 AS DOUBLE) / CAST(1000 AS DOUBLE) AS predict_s,
  CAST(event_id * 11 % 300 AS DOUBLE) / CAST(1000 AS DOUBLE) AS apply_s,
  event_id * 13 % 9 AS files_in_batch, event_id * 7 % 5 AS predict_queue,
  CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 128 ELSE 256 END AS effective_batch,
  CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 16 ELSE 32 END AS download_parallel
FROM {events}
"""
SESSIONS = """
SELECT CAST(floor(event_id / 40) AS BIGINT) AS session_id,
  CASE CAST(floor(event_id / 40) AS BIGINT) % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'empty_queue'
    WHEN 2 THEN 'invalid_request' ELSE 'ok' END AS outcome,
  CAST(floor(event_id / 40) AS BIGINT) % 2 = 0 AS stopped,
  count(*) AS batches, CAST(sum(event_id % 9 - 1) AS BIGINT) AS processed
FROM {events} GROUP BY 1, 2, 3
"""
TUNING_RUNS = """
SELECT event_id AS run_id, 'model-' || CAST(event_id * 31 % 12 AS STRING) AS model, ts AS saved_at,
  event_id % 256 + 1 AS batch_size, event_id % 32 + 1 AS download_parallel
FROM {events}
"""
LOG_LINES = """
SELECT 'run-' || CAST(CAST(floor(event_id / 500) AS BIGINT) AS STRING) AS run_id, event_id % 500 AS line_no,
  substr(CAST(ts AS STRING), 1, 19) || CASE
    WHEN event_type = 'error' AND event_id % 4 = 0 THEN ' WARNING [r] [app] load_model disk_cache_invalid model=m issues=[]'
    WHEN event_type = 'error' THEN ' ERROR [r] [app] something failed id=' || CAST(event_id AS STRING) || '  '
    WHEN event_type = 'signup' AND event_id % 4 = 0 THEN ' INFO [r] [app] ensure_model metrics model=m memory_cache_hit=True duration_ms=1.00'
    WHEN event_type = 'signup' AND event_id % 4 = 1 THEN ' INFO [r] [app] ensure_model metrics model=m memory_cache_hit=False duration_ms=9.00'
    WHEN event_type = 'signup' AND event_id % 4 = 2 THEN ' INFO [r] [ws] tagging_ws session_config apply_tags_http_batch=128 ort_cpu_threads_intra_inter='
      || CAST(event_id % 8 + 1 AS STRING) || '/1 config_inference_batch_saved=' || CAST(event_id % 32 AS STRING)
      || CASE WHEN event_id % 5 = 0 THEN '' ELSE ' apply_tags_every_n_effective=' || CAST(event_id % 16 AS STRING) END
    WHEN event_type = 'signup' THEN ' INFO [r] [app] load_model metrics model=m disk_cache_hit='
      || CASE event_id % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'False' ELSE 'n/a' END || ' hub_fetch_this_call='
      || CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END
    WHEN event_type = 'click' AND event_id % 3 = 0 THEN ' INFO [r] [ws] tagging_ws metadata_prefetch wall_s=1.' || CAST(100 + event_id % 900 AS STRING)
      || ' rows=' || CAST(event_id % 100 AS STRING) || ' file_ids=' || CAST(event_id % 100 AS STRING) || ' chunk=512'
    WHEN event_type = 'click' AND event_id % 3 = 1 THEN ' INFO [r] [ws] tagging_ws queue_analysis infer=' || CAST(event_id % 50 AS STRING)
      || ' skip_same_marker=' || CAST(event_id % 40 AS STRING) || ' skip_higher_tier=' || CAST(event_id % 7 AS STRING)
      || ' missing_metadata=' || CAST(event_id % 3 AS STRING) || ' queue_total=100'
    WHEN event_type = 'click' THEN ' INFO [r] [ws] tagging_ws session_metrics onnx_skipped_same_marker=' || CAST(event_id % 40 AS STRING)
      || ' onnx_skipped_higher_tier_marker=' || CAST(event_id % 7 AS STRING) || ' files_processed=' || CAST(event_id % 100 AS STRING)
      || ' tags_new_strings_applied=' || CAST(event_id % 300 AS STRING)
    WHEN event_type = 'view' THEN ' INFO [r] [svc] tag_files metrics model=m skipped_pre_infer_marker_files=' || CAST(event_id % 4 AS STRING)
      || ' inferred_files=' || CAST(event_id % 6 AS STRING) || ' wall_hydrus_fetch_s=0.' || CAST(100 + event_id % 900 AS STRING)
      || ' wall_onnx_predict_s=1.' || CAST(100 + event_id % 900 AS STRING)
    WHEN event_id % 3 = 0 THEN ' INFO [r] [perf] perf tagging_session wall_s=60.' || CAST(100 + event_id % 900 AS STRING)
      || ' model_prepare_s=0.000 processed=' || CAST(event_id % 100 AS STRING) || ' outer_batches=10 hydrus_files=50 tag_strings='
      || CAST(event_id % 300 AS STRING) || ' outcome=ok/complete model=m'
    WHEN event_id % 3 = 1 THEN ' DEBUG [r] [ws] tagging_ws session_perf_rates wall_s=60.000 inferred_non_skip=' || CAST(event_id % 50 AS STRING)
      || ' inferred_non_skip_per_s=0.' || CAST(1000 + event_id % 9000 AS STRING) || ' tags_new_strings_per_s=3.3333 outer_batches=10'
    WHEN event_id % 30 = 2 THEN ' INFO [r] [perf] perf process_shutdown uptime_s=' || CAST(event_id % 700 AS STRING) || '  '
    ELSE ' INFO [r] [perf] stats op=tagging_session label=''a b'' outcome=ok processed=' || CAST(event_id % 100 AS STRING)
      || ' wall_s=' || CAST(event_id % 60 AS STRING) END AS line
FROM {events}
"""
SESSION_EVENTS = """
SELECT CAST(floor(event_id / 40) AS BIGINT) AS session_id, event_id % 40 + 1 AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'queue_plan' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'file'
    WHEN 'click' THEN 'tags_applied' ELSE CASE event_id % 3 WHEN 0 THEN 'stopping' WHEN 1 THEN 'complete' ELSE 'server_shutting_down' END END AS type,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
FROM {events}
"""
VIEW_SQL = {
    "files": FILES,
    "queue": QUEUE,
    "file_tags": FILE_TAGS,
    "proposed": PROPOSED,
    "services": SERVICES,
    "tag_labels": TAG_LABELS,
    "batch_metrics": BATCH_METRICS,
    "sessions": SESSIONS,
    "tuning_runs": TUNING_RUNS,
    "log_lines": LOG_LINES,
    "session_events": SESSION_EVENTS,
}
TABLES = ("region", "nation", "part", "orders", "lineitem", "events", "embeddings")


class Library:
    """The views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str, **replaced: DataFrame) -> DataFrame:
        """A view; `replaced` puts other tables (such as streams) in the place of given ones."""
        text = VIEW_SQL[name]
        used = {t: replaced.get(t) or self.table(t) for t in TABLES if "{" + t + "}" in text}
        rows = self.spark.sql(text, **used)
        return rows.withColumn("tag_norm", normalize_tag("tag")) if name == "file_tags" else rows

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEW_SQL:
            return self.view(name)
        raise AttributeError(name)

    @cached_property
    def scores(self) -> DataFrame:
        """Score vectors from the embeddings: twice the absolute value."""
        doubled = F.transform("embedding", lambda x: (F.abs(x) * 2).cast("float"))
        return self.table("embeddings").select(F.col("vec_id").alias("file_id"), doubled.alias("probs"))

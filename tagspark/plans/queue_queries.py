"""Named queries: queue plan, markers, splits, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagspark.functions import numbers, text
from tagspark.operators import metrics, planning, splits
from tagspark.operators.browse import ordered_selection
from tagspark.plans.library import Library
from tagspark.plans.registry import part, query
from tagspark.session import cut_lineage
from tagspark.sources.media import route_media
from tagspark.sources.metadata import last_by_id

RULES = planning.SkipRules(model="wd-swinv2-tagger-v3")
SERVICE = "svc1"
SERVICE_RULES = planning.SkipRules(service_key=SERVICE)
BATCH_SIZE = 16
TAIL_CAP = 64

part(
    "tiers",
    "SELECT * FROM (VALUES ('wd-vit-tagger-v3', 1), ('wd-swinv2-tagger-v3', 2), "
    "('wd-vit-large-tagger-v3', 3), ('wd-eva02-large-tagger-v3', 4)) t(model, tier)",
)
part(
    "marks",
    "SELECT file_id, service_key, status, pos, tag, tag_norm, slug, coalesce(tier, 0) AS tier FROM "
    "(SELECT *, trim(substr(trim(tag), 6)) AS slug FROM file_tags WHERE lower(trim(tag)) LIKE 'wd14:%') "
    "LEFT JOIN tiers ON replace(slug, '_', '-') = model",
    "file_tags",
    "tiers",
)


def _decisions(marker: str, tier: int, where: str = "TRUE") -> str:
    return f"""
    SELECT q.pos, q.file_id, f.file_id IS NULL AS missing,
      CASE WHEN f.file_id IS NULL THEN NULL WHEN m.same THEN 'wd_model_marker_present'
           WHEN m.tier > {tier} THEN 'wd_skip_higher_tier_model_present' END AS skip_reason
    FROM queue q LEFT JOIN files f ON q.file_id = f.file_id
    LEFT JOIN (SELECT file_id, bool_or(tag_norm = '{marker}') AS same, max(tier) AS tier FROM marks
               WHERE {where} GROUP BY file_id) m ON q.file_id = m.file_id"""


part("decisions", _decisions("wd14:wd swinv2 tagger v3", 2), "queue", "files", "marks")
part(
    "service_decisions",
    _decisions("wd14:wd vit tagger v3", 1, f"service_key = '{SERVICE}'"),
    "queue",
    "files",
    "marks",
)
part(
    "ordered",
    """SELECT *, row_number() OVER (ORDER BY bucket, pos) - 1 AS ordinal FROM (SELECT *,
    CASE skip_reason WHEN 'wd_model_marker_present' THEN 1 WHEN 'wd_skip_higher_tier_model_present' THEN 2 ELSE 0 END AS bucket
    FROM decisions)""",
    "decisions",
)
_PLAN = """SELECT count(*) AS queue_total, count(*) FILTER (WHERE skip_reason IS NULL) AS infer_total,
  count(*) FILTER (WHERE skip_reason = 'wd_model_marker_present') AS skip_same_marker,
  count(*) FILTER (WHERE skip_reason = 'wd_skip_higher_tier_model_present') AS skip_higher_tier,
  count(*) FILTER (WHERE missing) AS missing_metadata FROM {}"""


@query("decisions", sql=_PLAN.format("decisions"))
def queue_plan(lib: Library) -> DataFrame:
    return planning.queue_plan(lib.queue, lib.files, lib.file_tags, RULES)


@query("service_decisions", sql=_PLAN.format("service_decisions"))
def queue_plan_service(lib: Library) -> DataFrame:
    return planning.queue_plan(lib.queue, lib.files, lib.file_tags, SERVICE_RULES)


def decided(lib: Library) -> DataFrame:
    return planning.skip_decisions(lib.queue, lib.files, lib.file_tags, RULES)


@query("decisions", sql="SELECT pos, file_id, skip_reason, missing FROM decisions")
def queue_decisions(lib: Library) -> DataFrame:
    return decided(lib).select("pos", "file_id", "skip_reason", "missing")


@query("ordered", sql="SELECT pos, file_id, CAST(bucket AS INT) AS bucket, ordinal FROM ordered")
def queue_infer_first(lib: Library) -> DataFrame:
    return planning.reorder_infer_first(decided(lib)).select("pos", "file_id", "bucket", "ordinal")


@query(
    "files",
    "marks",
    sql="""SELECT file_id FROM files WHERE file_id IN
    (SELECT file_id FROM marks WHERE service_key = 'svc1' AND tag_norm = 'wd14:wd swinv2 tagger v3')""",
)
def marker_present(lib: Library) -> DataFrame:
    return planning.marker_present(lib.files, lib.file_tags, RULES.marker, SERVICE).select("file_id")


@query(
    "marks",
    sql="""SELECT file_id, CAST(tier AS INT) AS tier, slug FROM (SELECT *, row_number() OVER
    (PARTITION BY file_id ORDER BY tier DESC, service_key, status, pos, tag) AS n FROM marks WHERE tier > 0) WHERE n = 1""",
)
def max_marker_tier(lib: Library) -> DataFrame:
    return planning.max_marker_tier(lib.file_tags)


@query(
    "marks",
    sql="SELECT slug, CAST(tier AS INT) AS tier, count(*) AS n FROM marks WHERE slug <> '' GROUP BY slug, tier",
)
def model_tiers(lib: Library) -> DataFrame:
    slugs = lib.file_tags.where(text.may_be_marker("tag_norm")).select(text.marker_slug("tag").alias("slug"))
    counts = slugs.where("slug IS NOT NULL").groupBy("slug").agg(F.count("*").alias("n"))
    return counts.select("slug", text.model_tier("slug").alias("tier"), "n")


@query(
    "queue",
    "files",
    sql="""SELECT q.pos, q.file_id, f.hash, f.size, f.mime, f.state, f.file_id IS NULL AS missing_metadata
    FROM queue q LEFT JOIN files f ON q.file_id = f.file_id""",
)
def attach_metadata(lib: Library) -> DataFrame:
    return planning.attach_metadata(lib.queue, lib.files)


@query(
    "queue",
    "files",
    sql="""SELECT file_id, hash, size, mime, state, CASE WHEN state = 'archive' THEN 'prefetch' ELSE 'source' END AS origin
    FROM files WHERE file_id IN (SELECT file_id FROM queue)""",
)
def merge_prefetch(lib: Library) -> DataFrame:
    return planning.merge_prefetch(lib.queue, lib.files.where("state = 'archive'"), lib.files)


@query(
    "proposed",
    sql="""SELECT file_id, pos, tag FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos DESC, tag DESC) AS n
    FROM proposed) WHERE n = 1""",
)
def last_row_by_id(lib: Library) -> DataFrame:
    rows = lib.proposed.withColumn("pos", F.struct("pos", "tag"))
    return last_by_id(rows).withColumn("pos", F.col("pos.pos"))


_REQUEST = "CASE WHEN o_orderkey % 3 = 0 THEN ' ' || CAST(o_orderkey AS STRING) || ' ' ELSE CAST(o_orderkey AS STRING) END"


@query(sql="SELECT o_orderkey AS file_id FROM orders")
def validate_queue(lib: Library) -> DataFrame:
    ok, _ = planning.validate_queue(lib.table("orders").select(F.expr(_REQUEST).alias("file_id")))
    return ok


@query(
    sql="""SELECT 'invalid_request' AS code, count(*) FILTER (WHERE o_orderkey % 1000 = 7) AS rows FROM orders
    HAVING count(*) FILTER (WHERE o_orderkey % 1000 = 7) > 0"""
)
def validate_queue_rejects(lib: Library) -> DataFrame:
    bad = "CASE WHEN o_orderkey % 1000 = 7 THEN 'x' || CAST(o_orderkey AS STRING) ELSE CAST(o_orderkey AS STRING) END"
    _, rejects = planning.validate_queue(lib.table("orders").select(F.expr(bad).alias("file_id")))
    return rejects


@query(
    "files",
    sql="""SELECT file_id, mime, CASE WHEN lower(trim(mime)) LIKE 'video/%' THEN 'thumbnail' ELSE 'full' END AS route
    FROM files""",
)
def media_route(lib: Library) -> DataFrame:
    return route_media(lib.files).select("file_id", "mime", "route")


# ---- calibration -----------------------------------------------------------------------------
part(
    "learning",
    """SELECT CASE WHEN n <= 1 THEN n ELSE greatest(1, least(greatest(32, CAST(ceil(CAST(0.1 AS DOUBLE) * n) AS BIGINT)), n - 1)) END AS k
    FROM (SELECT count(*) AS n FROM queue)""",
    "queue",
)


@query(
    "queue",
    "learning",
    sql="""SELECT pos, file_id, ordinal, CASE WHEN ordinal < k THEN 'learning' ELSE 'commit' END AS segment FROM
    (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS ordinal FROM queue), learning""",
)
def learning_split_count(lib: Library) -> DataFrame:
    return splits.learning_split(lib.queue)


def known_queue(lib: Library) -> DataFrame:
    """Queue rows whose file is known, so that every size is there."""
    return ordered_selection(lib.queue, lib.files)


part("known_queue", "SELECT * FROM queue WHERE file_id IN (SELECT file_id FROM files)", "queue", "files")
part(
    "byte_totals",
    """SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS total_bytes,
    CAST(ceil(CAST(0.2 AS DOUBLE) * CAST(sum(size) AS BIGINT)) AS BIGINT) AS target_bytes
    FROM known_queue q JOIN files f ON q.file_id = f.file_id""",
    "known_queue",
    "files",
)
part(
    "byte_split",
    """SELECT n, total_bytes, target_bytes, least(greatest(32, k), n - 1) AS split_index FROM byte_totals,
    (SELECT min(seen) AS k FROM (SELECT row_number() OVER (ORDER BY pos) AS seen, sum(size) OVER (ORDER BY pos) AS bytes
     FROM known_queue q JOIN files f ON q.file_id = f.file_id), byte_totals WHERE bytes >= target_bytes)""",
    "byte_totals",
)


@query(
    "byte_split",
    sql="""SELECT pos, file_id, ordinal, CASE WHEN ordinal < split_index THEN 'learning' ELSE 'commit' END AS segment FROM
    (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS ordinal FROM known_queue), byte_split""",
)
def learning_split_bytes(lib: Library) -> DataFrame:
    return splits.learning_split_bytes(known_queue(lib), lib.files, 0.2)


@query(
    "byte_split",
    sql="""SELECT n, total_bytes, target_bytes, CAST(NULL AS STRING) AS fallback, split_index,
    split_index AS learning_count FROM byte_split""",
)
def learning_split_info(lib: Library) -> DataFrame:
    return splits.learning_size_bytes(known_queue(lib), lib.files, 0.2)


@query(
    "learning",
    sql="""SELECT (SELECT count(*) FROM queue) AS n, CAST(NULL AS BIGINT) AS total_bytes, CAST(NULL AS BIGINT) AS target_bytes,
    'missing_size' AS fallback, k AS split_index, k AS learning_count FROM learning""",
)
def learning_split_fallback(lib: Library) -> DataFrame:
    return splits.learning_size_bytes(lib.queue, lib.files)


def batched(lib: Library) -> tuple[DataFrame, DataFrame]:
    """Queue rows in run order with their batch, and the plan counts.

    The learning part is the first rows of the run order. Decisions are needed for the counts and
    for the order, so they are written once.
    """
    decisions = cut_lineage(decided(lib), "decisions")
    plan = planning.plan_counts(decisions)
    split = splits.learning_size(lib.queue).select("learning_count").scalar()
    ordered = planning.reorder_infer_first(decisions)
    cut = plan.select("infer_total").scalar()
    return splits.assign_batches(ordered, BATCH_SIZE, cut, split, TAIL_CAP, tag_all=True), plan


part(
    "run_size",
    "SELECT count(*) AS total, count(*) FILTER (WHERE skip_reason IS NULL) AS cut, (SELECT k FROM learning) AS split FROM decisions",
    "decisions",
    "learning",
)
# Batch after batch, as a run goes: size 16, tail 64, a cut at the end of the learning part.
part(
    "batch_starts",
    """SELECT CAST(1 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS start, total, cut, split FROM run_size
    UNION ALL
    SELECT batch + 1, start + CASE WHEN cut > 0 AND start >= cut THEN greatest(16, least(64, total - start))
      WHEN split > 0 AND start < split AND split < start + 16 THEN split - start ELSE 16 END, total, cut, split
    FROM batch_starts WHERE start + CASE WHEN cut > 0 AND start >= cut THEN greatest(16, least(64, total - start))
      WHEN split > 0 AND start < split AND split < start + 16 THEN split - start ELSE 16 END < total""",
    "run_size",
)
part(
    "batched",
    "SELECT o.*, b.batch FROM ordered o ASOF JOIN batch_starts b ON o.ordinal >= b.start",
    "ordered",
    "batch_starts",
)


@query("batched", sql="SELECT pos, file_id, ordinal, batch FROM batched")
def assign_batches(lib: Library) -> DataFrame:
    return batched(lib)[0].select("pos", "file_id", "ordinal", "batch")


part(
    "summary",
    """SELECT batch, count(*) AS processed, count(*) FILTER (WHERE skip_reason = 'wd_model_marker_present') AS skipped_same,
    count(*) FILTER (WHERE skip_reason = 'wd_skip_higher_tier_model_present') AS skipped_higher,
    count(*) FILTER (WHERE skip_reason IS NULL) AS inferred,
    CAST(coalesce(sum(CASE WHEN skip_reason IS NULL THEN file_id % 3 ELSE 0 END), 0) AS BIGINT) AS stale_removed FROM batched GROUP BY batch""",
    "batched",
)


def summarized(lib: Library) -> tuple[DataFrame, DataFrame]:
    rows, plan = batched(lib)
    stale = F.when(F.col("skip_reason").isNull(), F.col("file_id") % 3).otherwise(F.lit(0))
    return metrics.batch_summary(rows.withColumn("stale_markers_removed", stale)), plan


@query("summary", sql="SELECT * FROM summary")
def batch_summary(lib: Library) -> DataFrame:
    return summarized(lib)[0]


@query(
    "summary",
    "run_size",
    sql="""SELECT batch, total_processed, total_inferred, total_skipped_same, total_skipped_higher, total_stale_removed,
    batch + CAST(ceil((total - total_processed) / 16.0) AS BIGINT) AS batches_total,
    CASE WHEN total_inferred < cut THEN total_inferred ELSE greatest(0, total_processed - cut) END AS bar_current,
    CASE WHEN total_inferred < cut THEN cut ELSE greatest(1, total - cut) END AS bar_total
    FROM (SELECT batch, CAST(sum(processed) OVER w AS BIGINT) AS total_processed, CAST(sum(inferred) OVER w AS BIGINT) AS total_inferred,
      CAST(sum(skipped_same) OVER w AS BIGINT) AS total_skipped_same, CAST(sum(skipped_higher) OVER w AS BIGINT) AS total_skipped_higher,
      CAST(sum(stale_removed) OVER w AS BIGINT) AS total_stale_removed FROM summary WINDOW w AS (ORDER BY batch)), run_size""",
)
def progress_counters(lib: Library) -> DataFrame:
    batches, plan = summarized(lib)
    total, infer_total = plan.select("queue_total").scalar(), plan.select("infer_total").scalar()
    return metrics.progress(cut_lineage(batches, "batches"), BATCH_SIZE, total, infer_total)


# ---- scalar functions over given columns ------------------------------------------------------
@query(
    "file_tags",
    sql="SELECT tag, tag_norm, count(*) AS n FROM file_tags GROUP BY tag, tag_norm",
)
def normalize_tags(lib: Library) -> DataFrame:
    counts = lib.view("file_tags").groupBy("tag").agg(F.count("*").alias("n"))
    return counts.select("tag", text.normalize_tag("tag").alias("tag_norm"), "n")


@query(
    sql="""SELECT p_brand, 'run:' || trim(p_brand) AS marker, 'wd14:' || trim(p_brand) AS default_marker, count(*) AS n
    FROM part GROUP BY p_brand"""
)
def model_markers(lib: Library) -> DataFrame:
    brands = lib.table("part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return brands.select(
        "p_brand",
        text.model_marker_col("p_brand", "run:{model_name}").alias("marker"),
        text.model_marker_col("p_brand").alias("default_marker"),
        "n",
    )


@query(
    sql="""SELECT event_id, least(greatest(event_id - 50, 1), 256) AS score_batch, least(greatest(event_id, 32), 2048) AS metadata_chunk,
    CASE WHEN event_id % 4 = 0 THEN 32 ELSE least(greatest(event_id, 1), 128) END AS tuning_window,
    CASE WHEN event_id % 5 = 0 THEN CAST(0.1 AS DOUBLE)
      ELSE least(greatest(CAST(event_id AS DOUBLE) / CAST(1000 AS DOUBLE), CAST(0.01 AS DOUBLE)), CAST(0.5 AS DOUBLE)) END AS fraction,
    CASE WHEN event_id > 5 THEN least(greatest(CAST(event_id - 5 AS DOUBLE), CAST(30 AS DOUBLE)), CAST(3600 AS DOUBLE)) END AS timeout_s
    FROM events"""
)
def clamped_settings(lib: Library) -> DataFrame:
    i = F.col("event_id")
    return lib.table("events").select(
        "event_id",
        numbers.clamp_setting(i - 50, "score_batch").alias("score_batch"),
        numbers.clamp_setting("event_id", "metadata_chunk").alias("metadata_chunk"),
        numbers.clamp_setting(F.when(i % 4 == 0, F.lit("bad")).otherwise(i.cast("string")), "tuning_window").alias("tuning_window"),
        numbers.clamp_fraction(F.when(i % 5 != 0, i / 1000.0)).alias("fraction"),
        numbers.clamp_timeout((i - 5).cast("string")).alias("timeout_s"),
    )


@query(
    sql="""SELECT event_id, CASE WHEN lo = hi THEN CAST(lo AS STRING)
      WHEN mid = lo THEN CAST(lo AS STRING) || ',' || CAST(hi AS STRING)
      ELSE CAST(lo AS STRING) || ',' || CAST(mid AS STRING) || ',' || CAST(hi AS STRING) END AS trials
    FROM (SELECT event_id, least(a, b) AS lo, greatest(a, b) AS hi, (a + b) // 2 AS mid FROM
      (SELECT event_id, event_id % 7 + 1 AS a, event_id % 33 + 1 AS b FROM events))"""
)
def triplets(lib: Library) -> DataFrame:
    i = F.col("event_id")
    return lib.table("events").select(
        "event_id", F.array_join(numbers.triplet(i % 7 + 1, i % 33 + 1), ",").alias("trials")
    )


@query(
    sql="""SELECT o_orderkey, o_orderpriority || '|' || o_orderstatus AS terms FROM orders"""
)
def parse_terms(lib: Library) -> DataFrame:
    raw = F.concat(F.lit(" , "), F.col("o_orderpriority"), F.lit(" ,, "), F.col("o_orderstatus"), F.lit(","))
    return lib.table("orders").select("o_orderkey", F.array_join(text.split_terms(raw), "|").alias("terms"))

"""Named queries: tag diff and apply, stored tags, score vectors, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagspark.defaults import RATING
from tagspark.functions import taglists, text
from tagspark.operators import browse, diff, metrics, planning, scores, scoring
from tagspark.operators.skew import tasks_for
from tagspark.plans.library import Library
from tagspark.plans.queue_queries import RULES, SERVICE, decided
from tagspark.plans.registry import norm, part, query
from tagspark.sources.actions import action_body
from tagspark.session import fresh_path
from tagspark.sources.labels import check_labels, read_labels, read_manifests, verify_artifacts

CHARACTER_CUT = 0.5

# ---- diff and apply --------------------------------------------------------------------------
part(
    "first_proposed",
    f"""SELECT file_id, tag_norm, pos, tag, proposed FROM (SELECT *, count(*) OVER (PARTITION BY file_id, tag_norm) AS proposed,
    row_number() OVER (PARTITION BY file_id, tag_norm ORDER BY pos, tag) AS n FROM
    (SELECT *, {norm('tag')} AS tag_norm FROM proposed)) WHERE n = 1""",
    "proposed",
)
part(
    "diffed",
    """SELECT p.*, s.file_id IS NULL AS is_new FROM first_proposed p LEFT JOIN
    (SELECT DISTINCT file_id, tag_norm FROM file_tags WHERE service_key = 'svc1') s
    ON p.file_id = s.file_id AND p.tag_norm = s.tag_norm""",
    "first_proposed",
    "file_tags",
)
part("new_tags", "SELECT file_id, pos, tag, tag_norm FROM diffed WHERE is_new", "diffed")


def diffed(lib: Library) -> DataFrame:
    return diff.tag_diff(lib.proposed, lib.file_tags, SERVICE)


def items(lib: Library) -> DataFrame:
    return lib.files.select("file_id", "hash")


@query("new_tags", sql="SELECT * FROM new_tags")
def tag_diff_new(lib: Library) -> DataFrame:
    return diff.filter_new_tags(lib.proposed, lib.file_tags, SERVICE)


@query(
    "diffed",
    sql="""SELECT file_id, CAST(sum(proposed) AS BIGINT) AS proposed, count(*) FILTER (WHERE is_new) AS kept,
    CAST(sum(proposed) AS BIGINT) - count(*) FILTER (WHERE is_new) AS skipped FROM diffed GROUP BY file_id""",
)
def tag_diff_stats(lib: Library) -> DataFrame:
    return diff.file_diff_stats(diffed(lib))


@query(
    "files",
    "diffed",
    sql="""SELECT count(*) AS items, count(*) FILTER (WHERE proposed > 0) AS with_tags, count(*) FILTER (WHERE kept > 0) AS files_written,
    CAST(sum(coalesce(kept, 0)) AS BIGINT) AS new_tag_strings, CAST(sum(coalesce(proposed - kept, 0)) AS BIGINT) AS duplicates_skipped,
    count(*) FILTER (WHERE proposed > 0 AND kept = 0) AS unchanged_all_dupes
    FROM files f LEFT JOIN (SELECT file_id, sum(proposed) AS proposed, count(*) FILTER (WHERE is_new) AS kept FROM diffed GROUP BY file_id) d
    ON f.file_id = d.file_id""",
)
def apply_stats(lib: Library) -> DataFrame:
    return diff.apply_stats(items(lib), diffed(lib), SERVICE)


@query(
    "files",
    "new_tags",
    sql="""SELECT hash, 'svc1' AS service_key, CAST(0 AS BIGINT) AS part, tags, '{"hashes":["' || hash
    || '"],"service_keys_to_actions_to_tags":{"svc1":{"0":["' || quoted || '"]}}}' AS body FROM
    (SELECT hash, string_agg(tag, '|' ORDER BY pos, tag) AS tags, string_agg(tag, '","' ORDER BY pos, tag) AS quoted
     FROM new_tags n JOIN files f ON n.file_id = f.file_id GROUP BY hash)""",
)
def tag_actions(lib: Library) -> DataFrame:
    actions = diff.build_tag_actions(items(lib), diffed(lib).where("is_new"), SERVICE)
    return actions.select(
        "hash", "service_key", "part", F.array_join("add_tags", "|").alias("tags"), action_body().alias("body")
    )


@query(
    "files",
    "queue",
    "diffed",
    sql="""SELECT count(*) AS items, count(*) FILTER (WHERE proposed > 0) AS with_tags, count(*) FILTER (WHERE kept > 0) AS files_written,
    CAST(sum(coalesce(kept, 0)) AS BIGINT) AS new_tag_strings, CAST(sum(coalesce(proposed - kept, 0)) AS BIGINT) AS duplicates_skipped,
    count(*) FILTER (WHERE proposed > 0 AND kept = 0) AS unchanged_all_dupes
    FROM queue q JOIN files f ON q.file_id = f.file_id
    LEFT JOIN (SELECT file_id, sum(proposed) AS proposed, count(*) FILTER (WHERE is_new) AS kept FROM diffed GROUP BY file_id) d
    ON f.file_id = d.file_id""",
)
def apply_stats_repeats(lib: Library) -> DataFrame:
    """Every queue item has its own list, so a file that is queued often counts as often.

    The lists of a file's items are equal here, so one is compared and counted for all of them.
    """
    queued = lib.queue.repartition(tasks_for(lib.queue), "file_id").groupBy("file_id").agg(F.count("*").alias("times"))
    return diff.apply_stats(queued.join(items(lib), "file_id"), diffed(lib), SERVICE, times="times")


@query(
    "files",
    "new_tags",
    "file_tags",
    sql="""SELECT hash, a.tags AS add_tags, g.tags AS remove_tags FROM files f
    LEFT JOIN (SELECT file_id, string_agg(tag, '|' ORDER BY pos, tag) AS tags FROM new_tags GROUP BY file_id) a ON f.file_id = a.file_id
    LEFT JOIN (SELECT file_id, string_agg(tag, '|' ORDER BY pos, tag) AS tags FROM file_tags
      WHERE service_key = 'svc1' AND tag_norm LIKE 'wd14:%' GROUP BY file_id) g ON f.file_id = g.file_id
    WHERE a.tags IS NOT NULL OR g.tags IS NOT NULL""",
)
def tag_actions_with_removes(lib: Library) -> DataFrame:
    """New tags are added and stored markers removed, in one action per file."""
    removes = lib.file_tags.where((F.col("service_key") == SERVICE) & F.startswith("tag_norm", F.lit("wd14:")))
    actions = diff.build_tag_actions(items(lib), diffed(lib).where("is_new"), SERVICE, removes.select("file_id", "pos", "tag"))
    return actions.select(
        "hash", F.array_join("add_tags", "|").alias("add_tags"), F.array_join("remove_tags", "|").alias("remove_tags")
    )


@query(
    "decisions",
    "diffed",
    sql="""SELECT count(*) AS results, count(*) FILTER (WHERE d.skip_reason IS NULL AND n.file_id IS NOT NULL) AS files_pending
    FROM decisions d
    LEFT JOIN (SELECT DISTINCT file_id FROM diffed WHERE is_new) n ON d.file_id = n.file_id""",
)
def pending_files(lib: Library) -> DataFrame:
    skipped = F.col("skip_reason").isNotNull().alias("skipped_inference")
    results = decided(lib).select("file_id", skipped)
    return diff.pending_files(results, diffed(lib))


# ---- stored tags -----------------------------------------------------------------------------
@query("file_tags", sql="SELECT DISTINCT file_id, tag_norm FROM file_tags WHERE service_key = 'svc1'")
def storage_keys_service(lib: Library) -> DataFrame:
    return diff.storage_keys(lib.file_tags, SERVICE)


@query("file_tags", sql="SELECT DISTINCT file_id, tag_norm FROM file_tags")
def storage_keys_all(lib: Library) -> DataFrame:
    return diff.storage_keys(lib.file_tags)


@query(
    "file_tags",
    "services",
    sql="""SELECT t.file_id, t.service_key, coalesce(s.name, left(t.service_key, 8) || '...') AS service_name, t.tags FROM
    (SELECT file_id, service_key, count(DISTINCT tag) AS tags FROM file_tags GROUP BY file_id, service_key) t
    LEFT JOIN services s ON t.service_key = s.service_key""",
)
def tag_counts_by_service(lib: Library) -> DataFrame:
    return browse.with_service_name(browse.tag_counts(lib.file_tags), lib.services)


part(
    "seen_tags",
    """SELECT file_id, service_key, tag, status, pos FROM (SELECT *, row_number() OVER
    (PARTITION BY file_id, service_key, tag ORDER BY status, pos) AS n FROM file_tags) WHERE n = 1""",
    "file_tags",
)


@query("seen_tags", sql="SELECT file_id, service_key, tag, status, pos FROM seen_tags")
def tags_by_service(lib: Library) -> DataFrame:
    return browse.first_seen_tags(lib.file_tags)


@query(
    "seen_tags",
    sql="""SELECT file_id, service_key, tag, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER
    (PARTITION BY file_id, service_key ORDER BY status, pos, tag) AS r FROM seen_tags) WHERE r <= 2""",
)
def top_tags(lib: Library) -> DataFrame:
    return browse.top_tags(lib.file_tags, 2)


part(
    "keyed_proposed", f"SELECT *, {norm('tag')} AS k FROM proposed", "proposed"
)
part(
    "marker_slots",
    """SELECT file_id, min(CASE WHEN k = 'wd14:wd swinv2 tagger v3' THEN pos END) AS slot, max(pos) AS last,
    count(*) FILTER (WHERE k LIKE 'wd14:%') AS markers FROM keyed_proposed GROUP BY file_id""",
    "keyed_proposed",
)


@query(
    "marker_slots",
    sql="""SELECT file_id, pos, tag FROM keyed_proposed WHERE k NOT LIKE 'wd14:%' UNION ALL
    SELECT file_id, coalesce(slot, last + 1) AS pos, 'wd14:wd-swinv2-tagger-v3' AS tag FROM marker_slots""",
)
def marker_dedupe(lib: Library) -> DataFrame:
    return diff.dedupe_marker_rows(lib.proposed, RULES.marker)[0]


@query(
    "marker_slots",
    sql="SELECT file_id, markers - CASE WHEN slot IS NULL THEN 0 ELSE 1 END AS removed FROM marker_slots",
)
def marker_dedupe_removed(lib: Library) -> DataFrame:
    return diff.dedupe_marker_rows(lib.proposed, RULES.marker)[1]


# ---- scores ----------------------------------------------------------------------------------
part(
    "passed",
    """SELECT file_id, label_idx, name, category, p FROM (SELECT vec_id AS file_id, i - 1 AS idx, CAST(abs(embedding[i]) * 2 AS FLOAT) AS p
      FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))
    JOIN tag_labels ON label_idx = idx
    WHERE category = 9 OR (category = 0 AND p >= CAST(0.35 AS FLOAT)) OR (category = 4 AND p >= CAST(0.5 AS FLOAT))""",
    "tag_labels",
)
part(
    "hits",
    """SELECT file_id, category, name AS tag, CAST(arg_max(p, label_idx) AS DOUBLE) AS conf, min(label_idx) AS place
    FROM passed GROUP BY file_id, category, name""",
    "passed",
)
part(
    "ranked",
    """SELECT file_id, category, tag, conf, place, row_number() OVER (PARTITION BY file_id, category ORDER BY conf DESC, place) - 1 AS rank
    FROM hits""",
    "hits",
)
part(
    "written",
    """SELECT file_id, category, rank, tag, CASE category WHEN 0 THEN replace(tag, '_', ' ') WHEN 4 THEN 'character:' || replace(tag, '_', ' ')
      ELSE 'rating:' || tag END AS text FROM ranked WHERE category <> 9 OR rank = 0""",
    "ranked",
)
part("vectors", "SELECT vec_id AS file_id FROM embeddings")
_CATEGORY_ORDER = "CASE category WHEN 0 THEN 0 WHEN 4 THEN 1 ELSE 2 END"
part(
    "flat",
    f"""SELECT v.file_id, coalesce(t.tags, '') AS tags FROM vectors v LEFT JOIN
    (SELECT file_id, string_agg(text, '|' ORDER BY {_CATEGORY_ORDER}, rank) AS tags FROM written GROUP BY file_id) t ON v.file_id = t.file_id""",
    "vectors",
    "written",
)


def scored(lib: Library) -> DataFrame:
    return scores.threshold_scores(lib.scores, lib.tag_labels, character_threshold=CHARACTER_CUT)


@query("ranked", sql="SELECT file_id, CAST(category AS INT) AS category, CAST(rank AS INT) AS rank, tag, conf FROM ranked")
def score_threshold(lib: Library) -> DataFrame:
    return scores.explode_predictions(scored(lib))


def _names(column: str):
    return F.array_join(F.transform(column, lambda x: x["tag"]), "|")


@query(
    "vectors",
    "ranked",
    sql="""SELECT v.file_id, coalesce(string_agg(tag, '|' ORDER BY rank) FILTER (WHERE category = 0), '') AS general,
    coalesce(string_agg(tag, '|' ORDER BY rank) FILTER (WHERE category = 4), '') AS characters,
    coalesce(string_agg(tag, '|' ORDER BY rank) FILTER (WHERE category = 9), '') AS ratings
    FROM vectors v LEFT JOIN ranked r ON v.file_id = r.file_id GROUP BY v.file_id""",
)
def score_sorted(lib: Library) -> DataFrame:
    return scored(lib).select(
        "file_id",
        _names("general_tags").alias("general"),
        _names("character_tags").alias("characters"),
        _names("rating_tags").alias("ratings"),
    )


@query("ranked", sql="SELECT file_id, tag AS rating, conf FROM ranked WHERE category = 9 AND rank = 0")
def top_rating(lib: Library) -> DataFrame:
    return scores.top_rating(scored(lib))


@query("flat", sql="SELECT file_id, tags FROM flat")
def format_tags(lib: Library) -> DataFrame:
    return scores.build_results(scored(lib)).select("file_id", F.array_join("tags", "|").alias("tags"))


@query(
    "vectors",
    "written",
    sql=f"""SELECT v.file_id, coalesce(bool_or({norm('text')} = 'twin label 21'), FALSE) AS found
    FROM vectors v LEFT JOIN written w ON v.file_id = w.file_id GROUP BY v.file_id""",
)
def contains_tag(lib: Library) -> DataFrame:
    results = scores.build_results(scored(lib))
    return results.select("file_id", taglists.contains_tag("tags", " Twin_Label-21 ").alias("found"))


@query(
    "ranked",
    "written",
    sql=f"""SELECT r.file_id, CAST(r.category AS INT) AS category, CAST(r.rank AS INT) AS rank, r.tag, r.conf FROM ranked r
    JOIN written w ON r.file_id = w.file_id AND r.category = w.category AND r.rank = w.rank
    WHERE (r.file_id, {norm('w.text')}) IN (SELECT file_id, {norm('text')} FROM written WHERE length(text) % 2 = 0)""",
)
def prune_to_pending(lib: Library) -> DataFrame:
    tagged = scored(lib)
    flat = scores.build_results(tagged).select("file_id", F.explode("tags").alias("tag"))
    pending = flat.where(F.length("tag") % 2 == 0).withColumn("tag_norm", text.normalize_tag("tag"))
    return diff.prune_to_pending(scores.explode_predictions(tagged), pending)


@query(
    "flat",
    sql="""SELECT file_id, CASE file_id % 3 WHEN 0 THEN 'kept' WHEN 1 THEN 'formatted' ELSE tags END AS tags FROM flat""",
)
def result_tags(lib: Library) -> DataFrame:
    none = F.array().cast("array<string>")
    turn = F.col("file_id") % 3
    kept = F.when(turn == 0, F.array(F.lit("kept"))).otherwise(none)
    formatted = F.when(turn == 1, F.array(F.lit("formatted"))).when(turn == 0, none)
    flat = taglists.result_tags(kept, formatted, "general_tags", "character_tags", "rating_tags")
    return scored(lib).select("file_id", F.array_join(flat, "|").alias("tags"))


_ASSEMBLED = """SELECT pos, file_id, TRUE AS skipped_inference, skip_reason, 'wd14:wd-swinv2-tagger-v3' AS marker, '' AS tags
    FROM decisions WHERE skip_reason IS NOT NULL UNION ALL
    SELECT d.pos, d.file_id, FALSE, NULL, NULL, CASE WHEN f.tags = '' THEN '' ELSE f.tags || '|' END || 'wd14:wd-swinv2-tagger-v3'
    FROM decisions d JOIN flat f ON d.file_id = f.file_id WHERE d.skip_reason IS NULL"""


@query("decisions", "flat", sql=_ASSEMBLED)
def assemble_results(lib: Library) -> DataFrame:
    results = scores.build_results(scored(lib), RULES.marker)
    rows = scores.assemble_results(decided(lib), results, RULES.marker)
    return rows.select(
        "pos", "file_id", "skipped_inference", "skip_reason", "marker", F.array_join("tags", "|").alias("tags")
    )


@query("decisions", "flat", sql=_ASSEMBLED)
def score_pending(lib: Library) -> DataFrame:
    def make():  # a stand-in classifier: twice the absolute value of each input number
        import numpy as np

        return lambda inputs: np.abs(np.asarray(inputs, dtype=np.float32)) * np.float32(2.0)

    media = lib.table("embeddings").select(F.col("vec_id").alias("file_id"), "embedding")
    rows = scoring.score_pending(
        lib.queue,
        lib.files,
        lib.file_tags,
        media,
        lib.tag_labels,
        make,
        ["embedding"],
        RULES,
        character_threshold=CHARACTER_CUT,
        batch_size=256,
        input_tensor_shapes=[[64]],
    )
    return rows.select(
        "pos", "file_id", "skipped_inference", "skip_reason", "marker", F.array_join("tags", "|").alias("tags")
    )


def _stand_in_library():
    """Fetches a file's id as its bytes; some files have no media, some cannot be reached."""

    def fetch(file_id: int, kind: str) -> bytes | None:
        if file_id % 11 == 0:
            raise OSError(f"no answer for {file_id}")
        if file_id % 7 == 0 and (kind == "full" or file_id % 5 == 0):
            return None
        return f"{kind}:{file_id}".encode()

    return fetch


def _stand_in_classifier():
    """Scores by id; some files break it."""

    def predict(contents: list[bytes]) -> list[list[float]]:
        ids = [int(content.split(b":")[1]) for content in contents]
        if any(i % 13 == 0 for i in ids):
            raise ValueError("cannot score")
        return [[(i % 16) / 16.0, float(content.startswith(b"full"))] for i, content in zip(ids, contents, strict=True)]

    return predict


# Ids are told by their remainders: by 11 no answer, by 7 no whole file, by 35 none at all, by 13 no scores.
_STAGES = """CASE WHEN d.file_id % 11 = 0 THEN 'fetch' WHEN d.file_id % 35 = 0 THEN 'media' WHEN d.file_id % 13 = 0 THEN 'predict' END"""


@query(
    "decisions",
    "files",
    sql=f"""SELECT DISTINCT d.file_id, CAST(d.file_id % 16 AS DOUBLE) / CAST(16 AS DOUBLE) AS score,
    lower(trim(coalesce(f.mime, ''))) NOT LIKE 'video/%' AND d.file_id % 7 <> 0 AS is_full
    FROM decisions d JOIN files f ON d.file_id = f.file_id WHERE skip_reason IS NULL AND {_STAGES} IS NULL""",
)
def fetched_scores(lib: Library) -> DataFrame:
    wanted = scoring.wanted_media(decided(lib), lib.files)
    found = scoring.fetch_and_score(wanted, _stand_in_library, _stand_in_classifier, batch_size=32, alone=True)
    probs = F.col("probs")
    return found.where("stage IS NULL").select("file_id", probs[0].cast("double").alias("score"), (probs[1] > 0).alias("is_full"))


@query(
    "decisions",
    "files",
    sql=f"""SELECT DISTINCT d.file_id, {_STAGES} AS stage, CASE {_STAGES} WHEN 'fetch' THEN 'OSError: no answer for ' || CAST(d.file_id AS VARCHAR)
    WHEN 'media' THEN 'no readable file or thumbnail' ELSE 'ValueError: cannot score' END AS error
    FROM decisions d JOIN files f ON d.file_id = f.file_id WHERE skip_reason IS NULL AND {_STAGES} IS NOT NULL""",
)
def score_rejects(lib: Library) -> DataFrame:
    _, rejects = scoring.score_pending_media(
        lib.queue, lib.files, lib.file_tags, lib.tag_labels, _stand_in_library, _stand_in_classifier, RULES, batch_size=32, alone=True
    )
    return rejects


@query(
    "diffed",
    "files",
    sql="""SELECT d.file_id, string_agg(tag, '|' ORDER BY pos, tag) AS tags FROM diffed d JOIN files f ON d.file_id = f.file_id
    WHERE is_new AND f.state = 'archive' GROUP BY d.file_id""",
)
def applicable_results(lib: Library) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "tag")))
    new = diffed(lib).where("is_new").groupBy("file_id").agg(F.transform(ordered, lambda t: t["tag"]).alias("tags"))
    hashes = lib.files.select("file_id", F.when(F.col("state") == "archive", F.col("hash")).alias("hash"))
    rows = hashes.join(new, "file_id", "left")
    return diff.applicable(rows).select("file_id", F.array_join("tags", "|").alias("tags"))


@query("tag_labels", sql="SELECT 'csv_too_few_rows:' || CAST(count(*) AS STRING) AS issue FROM tag_labels HAVING count(*) < 100")
def check_label_table(lib: Library) -> DataFrame:
    return check_labels(lib.tag_labels)


@query(
    "tag_labels",
    sql="SELECT CAST(row_number() OVER (ORDER BY label_idx) - 1 AS INT) AS label_idx, tag_id, name, category, CAST(count AS INT) AS count FROM tag_labels",
)
def labels_from_csv(lib: Library) -> DataFrame:
    """The vocabulary written as a label file, which is one file by definition, and read again."""
    path = fresh_path(lib.spark, "label-file")
    ordered = lib.tag_labels.coalesce(1).sortWithinPartitions("label_idx").drop("label_idx")
    ordered.write.option("header", True).option("escape", '"').csv(path)
    return read_labels(lib.spark, path)


# An order stands for a model in the store; its price and key give sizes, revisions and gaps.
_STORE = "SELECT o_orderkey AS k, 'm' || CAST(o_orderkey AS STRING) AS model, CAST(floor(o_totalprice * 20) AS BIGINT) AS onnx FROM {orders}"
part(
    "artifact_checks",
    """SELECT model, issues, unknown, k % 13 <> 0 AND k % 3 <> 0 AS manifest_present, CASE WHEN NOT unknown THEN local END AS local_revision,
    CASE WHEN NOT unknown AND NOT absent THEN remote END AS remote_revision, issues = '' OR issues IN ('newer_revision_on_hub', 'manifest_missing_revision_cannot_compare_hub') AS ok
    FROM (SELECT *, CASE WHEN unknown THEN 'unknown_model' WHEN absent THEN 'missing_required_files' ELSE concat_ws('|',
      CASE WHEN onnx < 1000000 THEN 'onnx_too_small:' || CAST(onnx AS STRING) END, CASE WHEN k % 2000 < 800 THEN 'csv_too_small:' || CAST(k % 2000 AS STRING) END,
      CASE WHEN k % 3 <> 0 AND k % 4 = 0 THEN 'size_mismatch_vs_manifest:model.onnx' END,
      CASE WHEN remote <> local THEN 'newer_revision_on_hub' END,
      CASE WHEN remote IS NOT NULL AND local IS NULL THEN 'manifest_missing_revision_cannot_compare_hub' END) END AS issues
    FROM (SELECT *, k % 13 = 0 AS unknown, k % 10 = 1 AS absent, CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN 'r' || CAST(k % 7 AS STRING) END AS local,
      CASE WHEN k % 2 = 0 THEN 'r' || CAST(k % 6 AS STRING) END AS remote FROM (""" + _STORE.format(orders="orders") + """) AS store) AS a) AS b""",
)


def checked_artifacts(lib: Library) -> DataFrame:
    store = lib.spark.sql(_STORE, orders=lib.table("orders"))
    onnx = store.select("model", F.lit("model.onnx").alias("file"), F.col("onnx").alias("length"))
    csv = store.where("k % 10 <> 1").select("model", F.lit("selected_tags.csv").alias("file"), (F.col("k") % 2000).alias("length"))
    recorded = F.col("onnx") + F.when(F.col("k") % 4 == 0, F.lit(1)).otherwise(F.lit(0))
    revision = F.when(F.col("k") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("r"), (F.col("k") % 7).cast("string")))
    text = F.format_string('{"model_name": "%s", "revision_sha": "%s", "files": {"model.onnx": {"size": %d}, "selected_tags.csv": {}}}', "model", revision, recorded)
    manifests = read_manifests(store.where("k % 3 <> 0").select(text.alias("value")))
    remote = store.where("k % 2 = 0").select("model", F.concat(F.lit("r"), (F.col("k") % 6).cast("string")).alias("remote_revision"))
    return verify_artifacts(store.select("model"), onnx.unionByName(csv), manifests, remote=remote, supported=store.where("k % 13 <> 0"))


@query(
    "artifact_checks",
    sql="SELECT model, ok, issues, manifest_present, local_revision, remote_revision FROM artifact_checks",
)
def artifact_checks(lib: Library) -> DataFrame:
    found = checked_artifacts(lib)
    return found.select("model", "ok", F.array_join("issues", "|").alias("issues"), "manifest_present", "local_revision", "remote_revision")


@query("artifact_checks", sql="SELECT count(*) AS count, count(*) FILTER (WHERE ok) AS ok_count FROM artifact_checks")
def artifact_summary(lib: Library) -> DataFrame:
    return metrics.verify_summary(checked_artifacts(lib))

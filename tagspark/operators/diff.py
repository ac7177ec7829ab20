"""Proposed tags against stored tags: what is new, what to write, what stays pending.

Tags are long rows (file_id, pos, tag); lists appear only in write actions, and there in parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tagspark.defaults import (
    CHARACTER,
    CHARACTER_PREFIX,
    GENERAL,
    GENERAL_PREFIX,
    MARKER_PREFIX,
    RATING,
    RATING_PREFIX,
)
from tagspark.functions.text import is_blank, normalize_tag, normalize_text
from tagspark.operators.planning import tags_of_service
from tagspark.operators.skew import tasks_for


def storage_keys(
    file_tags: DataFrame, service_key: str | None = None, statuses: Sequence[str] | None = None
) -> DataFrame:
    """Distinct (file_id, tag_norm) of one service, or of all services together.

    Every status counts as stored unless `statuses` names the ones that do.
    """
    rows = tags_of_service(file_tags, service_key)
    if statuses is not None:
        rows = rows.where(F.col("status").isin(*statuses))
    return rows.select("file_id", "tag_norm").distinct()


def tag_diff(
    proposed: DataFrame, file_tags: DataFrame, service_key: str, keys: Sequence[str] = ("file_id",)
) -> DataFrame:
    """One row per list and normal form: first position and spelling, repeats, and `is_new`.

    `keys` tell the lists of proposals apart and hold `file_id`. A file that is queued twice has a
    list per queue item: name the item there as well, or its repeats count as repeats in one list.
    Both sides are dealt by (file_id, tag_norm) into tasks of a bounded number of rows and reduced
    to one row each before they meet, so a file with very many tags is spread. Repeats of one tag
    of a file meet in one task, which holds a single group for them.
    """
    # A blank service key means nothing is stored there.
    known = tags_of_service(file_tags.where(F.lit(bool((service_key or "").strip()))), service_key)
    n = tasks_for(proposed, known)
    first = (
        proposed.withColumn("tag_norm", normalize_tag("tag"))
        .repartition(n, "file_id", "tag_norm")
        .groupBy(*keys, "tag_norm")
        .agg(F.min(F.struct("pos", "tag")).alias("first"), F.count("*").alias("proposed"))
    )
    dealt = known.select("file_id", "tag_norm").repartition(n, "file_id", "tag_norm")
    stored = dealt.distinct().withColumn("stored", F.lit(True))
    return first.join(stored, ["file_id", "tag_norm"], "left").select(
        *keys,
        "tag_norm",
        F.col("first.pos").alias("pos"),
        F.col("first.tag").alias("tag"),
        "proposed",
        F.col("stored").isNull().alias("is_new"),
    )


def filter_new_tags(
    proposed: DataFrame, file_tags: DataFrame, service_key: str, keys: Sequence[str] = ("file_id",)
) -> DataFrame:
    """Proposed tags that are not stored yet, each once, as first spelled: keys, pos, tag, tag_norm."""
    return tag_diff(proposed, file_tags, service_key, keys).where("is_new").select(*keys, "pos", "tag", "tag_norm")


def file_diff_stats(diff: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Per file, or per list of proposals: proposed, kept, skipped."""
    kept = F.count_if("is_new")
    return diff.groupBy(*keys).agg(
        F.sum("proposed").alias("proposed"), kept.alias("kept"), (F.sum("proposed") - kept).alias("skipped")
    )


def applicable(results: DataFrame) -> DataFrame:
    """Result rows with a hash and something to add or to remove."""
    adds = F.coalesce(F.size("tags"), F.lit(0))
    removes = F.coalesce(F.size("remove_tags"), F.lit(0)) if "remove_tags" in results.columns else F.lit(0)
    return results.where((F.length("hash") > 0) & ((adds > 0) | (removes > 0)))


def apply_stats(
    items: DataFrame,
    diff: DataFrame,
    service_key: str,
    removes: DataFrame | None = None,
    keys: Sequence[str] = ("file_id",),
    times: str | None = None,
) -> DataFrame:
    """One row of write counts for items (keys, hash); all zero without a service key.

    With an item's own column among `keys`, each item is counted by its own list. Items with equal
    lists may be one row each whose column `times` says how many they are.
    """
    counts = file_diff_stats(diff, keys)
    if removes is not None:
        gone = removes.groupBy(*keys).agg(F.count("*").alias("removed"))
        counts = counts.join(gone, [*keys], "full_outer")
    else:
        counts = counts.withColumn("removed", F.lit(0))
    active = F.lit(bool((service_key or "").strip()))
    joined = items.where(active).join(counts, [*keys], "left")
    adds, dels = F.coalesce("proposed", F.lit(0)), F.coalesce("removed", F.lit(0))
    kept = F.coalesce("kept", F.lit(0))
    usable = F.coalesce(F.length("hash") > 0, F.lit(False)) & ((adds > 0) | (dels > 0))
    written = usable & ((kept > 0) | (dels > 0))
    zero = F.lit(0).cast("bigint")
    weight = F.lit(1).cast("bigint") if times is None else F.col(times)

    def total(condition: Column, value: Column | None = None) -> Column:
        return F.coalesce(F.sum(F.when(condition, weight if value is None else value * weight)), zero)

    return joined.agg(
        total(F.lit(True)).alias("items"),
        total(usable).alias("with_tags"),
        total(written).alias("files_written"),
        total(written, kept).alias("new_tag_strings"),
        total(usable, F.coalesce("skipped", zero)).alias("duplicates_skipped"),
        total(usable & ~written).alias("unchanged_all_dupes"),
    )


def build_tag_actions(
    items: DataFrame,
    adds: DataFrame,
    service_key: str,
    removes: DataFrame | None = None,
    tags_per_action: int | None = None,
    keys: Sequence[str] = ("file_id",),
) -> DataFrame:
    """Write actions: hash, service_key, part, add_tags, remove_tags (null where empty).

    There is one action per file, or per item if `keys` name one. `tags_per_action` splits long lists:
    positions are list positions, so a part holds at most that many tags of each kind. Files
    without a hash and empty actions are absent.
    """
    part = F.lit(0).cast("bigint") if tags_per_action is None else F.expr(f"pos div {int(tags_per_action)}")
    part = part.alias("part")
    rows = adds.select(*keys, part, "pos", "tag", F.lit(True).alias("adding"))
    if removes is not None:
        rows = rows.unionByName(removes.select(*keys, part, "pos", "tag", F.lit(False).alias("adding")))

    def tags(adding: Column) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(adding, F.struct("pos", "tag"))))
        return F.when(F.size(ordered) > 0, F.transform(ordered, lambda t: t["tag"]))

    parts = rows.groupBy(*keys, "part").agg(
        tags(F.col("adding")).alias("add_tags"), tags(~F.col("adding")).alias("remove_tags")
    )
    named = items.where(F.length("hash") > 0).select(*keys, "hash")
    return parts.join(named, [*keys]).select(
        "hash", F.lit(service_key).alias("service_key"), "part", "add_tags", "remove_tags"
    )


def pending_files(results: DataFrame, diff: DataFrame) -> DataFrame:
    """One row: results, pending (results with new tags left). Skipped results are never pending.

    Results are counted per file first, so a file with very many results is one row in the join.
    """
    scored = F.count_if(F.coalesce(~F.col("skipped_inference"), F.lit(True)))
    per_file = results.groupBy("file_id").agg(F.count("*").alias("n"), scored.alias("scored"))
    left = diff.where("is_new").select("file_id").distinct().withColumn("_new", F.lit(True))
    zero = F.lit(0)
    return per_file.join(left, "file_id", "left").agg(
        F.coalesce(F.sum("n"), zero).alias("results"),
        F.coalesce(F.sum(F.when(F.col("_new"), F.col("scored"))), zero).alias("files_pending"),
    )


def prune_to_pending(
    predictions: DataFrame,
    pending: DataFrame,
    general_prefix: str = GENERAL_PREFIX,
    character_prefix: str = CHARACTER_PREFIX,
    rating_prefix: str = RATING_PREFIX,
) -> DataFrame:
    """Predictions (file_id, category, rank, tag, conf) whose written form is pending.

    Of the ratings only the top one can stay. `pending` holds (file_id, tag_norm).
    """
    spaced = F.translate("tag", "_", " ")
    written = (
        F.when(F.col("category") == GENERAL, F.concat(F.lit(general_prefix or ""), spaced))
        .when(F.col("category") == CHARACTER, F.concat(F.lit(character_prefix or ""), spaced))
        .when(F.col("category") == RATING, F.concat(F.lit(rating_prefix or ""), F.col("tag")))
    )
    candidates = predictions.where((F.col("category") != RATING) | (F.col("rank") == 0)).withColumn(
        "tag_norm", normalize_tag(written)
    )
    keys = pending.select("file_id", "tag_norm").distinct()
    return candidates.join(keys, ["file_id", "tag_norm"], "left_semi").select(predictions.columns)


def dedupe_marker_rows(
    tags: DataFrame, canonical: str, prefix: str = MARKER_PREFIX
) -> tuple[DataFrame, DataFrame]:
    """`functions.taglists.dedupe_markers` for long rows: (file_id, pos, tag) and removed counts.

    The canonical marker takes the first position at which it stood, or one past the last.
    """
    marker = (canonical or "").strip()
    current, start = normalize_text(marker), normalize_text(prefix)
    if not marker or not current.startswith(start):
        untouched = tags.groupBy("file_id").agg(F.lit(0).cast("bigint").alias("removed"))
        return tags.select("file_id", "pos", "tag"), untouched
    keyed = tags.where(~is_blank("tag")).withColumn("_key", normalize_tag("tag"))
    is_marker = F.startswith("_key", F.lit(start))
    is_current = F.col("_key") == current
    per_file = tags.withColumn("_key", normalize_tag("tag")).groupBy("file_id").agg(
        F.min(F.when(is_current, F.col("pos"))).alias("slot"),
        F.max("pos").alias("last"),
        F.count_if(is_marker & ~is_blank("tag")).alias("markers"),
    )
    placed = per_file.select(
        "file_id", F.coalesce("slot", F.col("last") + 1).alias("pos"), F.lit(marker).alias("tag")
    )
    removed = per_file.select(
        "file_id", (F.col("markers") - F.when(F.col("slot").isNull(), 0).otherwise(1)).alias("removed")
    )
    kept = keyed.where(~is_marker).select("file_id", "pos", "tag")
    return kept.unionByName(placed), removed


def draft_diff(base: DataFrame, draft: DataFrame) -> DataFrame:
    """Exact text differences per file: (file_id, tag, action) with action add or remove.

    One grouping instead of a full outer join, so repeats are folded before the shuffle.
    """
    both = base.select("file_id", "tag", F.lit(1).alias("b"), F.lit(0).alias("d")).unionByName(
        draft.select("file_id", "tag", F.lit(0).alias("b"), F.lit(1).alias("d"))
    )
    sides = both.groupBy("file_id", "tag").agg(F.max("b").alias("b"), F.max("d").alias("d"))
    return sides.where("b <> d").select(
        "file_id", "tag", F.when(F.col("d") == 1, F.lit("add")).otherwise(F.lit("remove")).alias("action")
    )

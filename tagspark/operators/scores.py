"""Score vectors to tags. Everything happens inside the row; nothing is exploded or shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagspark.defaults import (
    CHARACTER,
    CHARACTER_THRESHOLD,
    GENERAL,
    GENERAL_THRESHOLD,
    MARKER_PREFIX,
    MAX_LABELS,
    RATING,
)
from tagspark.functions.taglists import dedupe_markers, format_tags
from tagspark.operators.skew import lookup_join


def vocabulary(labels: DataFrame, max_labels: int = MAX_LABELS) -> Column:
    """The label table as one array value; entry i belongs to score i.

    A label table is the fixed vocabulary of a classifier. The query fails, rather than embed a
    large value in every task, if there are more than `max_labels` or if indices have gaps.
    """
    same_name = Window.partitionBy("category", "name").orderBy("label_idx")
    whole = same_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row more than allowed is enough to tell that there are too many; nothing is cut off.
    entries = labels.limit(max_labels + 1).select(
        F.col("label_idx").cast("int").alias("label_idx"),
        "name",
        F.col("category").cast("int").alias("category"),
        F.collect_list(F.col("label_idx").cast("int")).over(whole).alias("twins"),
    )
    row = entries.agg(
        F.count("*").alias("n"),
        F.max("label_idx").alias("top"),
        F.array_sort(F.collect_list(F.struct("label_idx", "name", "category", "twins"))).alias("all"),
    )
    sound = (F.col("n") <= max_labels) & (F.coalesce("top", F.lit(-1)) + 1 == F.col("n"))
    problem = F.raise_error(F.lit("label table is too large or its indices have gaps"))
    return row.select(F.when(sound, F.col("all")).otherwise(problem)).scalar()


def threshold_scores(
    scores: DataFrame,
    labels: DataFrame,
    general_threshold: float = GENERAL_THRESHOLD,
    character_threshold: float = CHARACTER_THRESHOLD,
) -> DataFrame:
    """Adds general_tags, character_tags, rating_tags: arrays of struct(tag, conf), best first.

    Thresholds are compared as 32-bit floats. All ratings stay. Equal scores keep label order. Of
    labels with one name and category the last passing one gives the score and the first passing
    one the place.
    """
    vocab = vocabulary(labels)
    probs = F.col("probs")

    def passes(category: Column, p: Column) -> Column:
        general = (category == GENERAL) & (p >= F.lit(general_threshold).cast("float"))
        character = (category == CHARACTER) & (p >= F.lit(character_threshold).cast("float"))
        return ((general | character) & ~F.isnan(p)) | (category == RATING)

    # Scores and labels side by side; a score beyond the last label has no label and falls out.
    paired = scores.withColumn("_pairs", F.arrays_zip(probs.alias("p"), vocab.alias("label")))
    passed = F.filter("_pairs", lambda x: passes(x["label"]["category"], x["p"]))

    def ranked(x: Column) -> Column:
        label = x["label"]
        alive = F.filter(label["twins"], lambda j: passes(label["category"], F.get(probs, j)))
        twins = F.when(F.size(label["twins"]) > 1, alive).otherwise(label["twins"])
        return F.struct(
            (-x["p"]).alias("order"),
            F.array_min(twins).alias("place"),
            (F.array_max(twins) == label["label_idx"]).alias("last"),
            label["category"].alias("category"),
            label["name"].alias("tag"),
            x["p"].cast("double").alias("conf"),
        )

    hits = F.array_sort(F.filter(F.transform(passed, ranked), lambda x: x["last"]))

    def of(category: int) -> Column:
        return F.transform(
            F.filter("_hits", lambda x: x["category"] == category),
            lambda x: F.struct(x["tag"].alias("tag"), x["conf"].alias("conf")),
        )

    return paired.withColumn("_hits", hits).select(
        *scores.columns,
        of(GENERAL).alias("general_tags"),
        of(CHARACTER).alias("character_tags"),
        of(RATING).alias("rating_tags"),
    )


def explode_predictions(scored: DataFrame) -> DataFrame:
    """Long rows (file_id, category, rank, tag, conf); rank 0 is the best of its category."""

    def rows(column: str, category: int) -> Column:
        return F.transform(
            column,
            lambda x, i: F.struct(
                F.lit(category).alias("category"),
                i.alias("rank"),
                x["tag"].alias("tag"),
                x["conf"].alias("conf"),
            ),
        )

    every = F.concat(
        rows("general_tags", GENERAL), rows("character_tags", CHARACTER), rows("rating_tags", RATING)
    )
    return scored.select("file_id", F.inline(every))


def top_rating(scored: DataFrame) -> DataFrame:
    """Best rating per file: file_id, rating, conf (null where there is none)."""
    best = F.get("rating_tags", F.lit(0))
    return scored.select("file_id", best["tag"].alias("rating"), best["conf"].alias("conf"))


def build_results(
    scored: DataFrame,
    marker: str = "",
    append_marker: bool = True,
    marker_prefix: str = MARKER_PREFIX,
    **prefixes: str,
) -> DataFrame:
    """Adds formatted_tags, tags and stale_markers_removed, with the run's marker set once."""
    flat = format_tags("general_tags", "character_tags", "rating_tags", **prefixes)
    if not (append_marker and marker):
        return scored.withColumn("formatted_tags", flat).withColumn("tags", F.col("formatted_tags")).withColumn(
            "stale_markers_removed", F.lit(0)
        )
    return (
        scored.withColumn("_flat", flat)
        .withColumn("_marked", dedupe_markers("_flat", marker, marker_prefix))
        .select(
            *scored.columns,
            F.col("_marked.tags").alias("formatted_tags"),
            F.col("_marked.tags").alias("tags"),
            F.col("_marked.removed").alias("stale_markers_removed"),
        )
    )


def assemble_results(decisions: DataFrame, inferred: DataFrame, marker: str) -> DataFrame:
    """Results in queue terms: skipped rows plus scored rows; files that failed to score drop out.

    `decisions` are queue rows with skip_reason; `inferred` holds one row per scored file.
    """
    skipped = decisions.where(F.col("skip_reason").isNotNull()).select(
        "pos",
        "file_id",
        F.lit(True).alias("skipped_inference"),
        "skip_reason",
        F.lit(marker).alias("marker"),
        F.array().cast("array<string>").alias("tags"),
        F.lit(0).alias("stale_markers_removed"),
    )
    waiting = decisions.where(F.col("skip_reason").isNull()).select("pos", "file_id")
    scored = lookup_join(
        waiting, inferred.select("file_id", "tags", "stale_markers_removed"), "file_id", "pos", "inner"
    )
    return skipped.unionByName(
        scored.withColumn("skipped_inference", F.lit(False)), allowMissingColumns=True
    )

"""Which files still need scoring: marker lookup, skip decision, plan counts, queue order."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tagspark.defaults import (
    DEFAULT_MODEL,
    MARKER_PREFIX,
    MODEL_TIERS,
    SKIP_HIGHER_TIER,
    SKIP_SAME_MARKER,
)
from tagspark.functions.text import (
    marker_slug,
    marker_start,
    may_be_marker,
    model_marker,
    model_tier,
    normalize_text,
    strip,
    tier_of,
)
from tagspark.operators.ordered import with_ordinal
from tagspark.operators.skew import SALT, hot_keys, lookup_join, repeat_rows, salt_rows, tasks_for


@dataclass(frozen=True)
class SkipRules:
    """The run settings that decide on skipping."""

    model: str = DEFAULT_MODEL
    service_key: str = ""
    marker_template: str = ""
    marker_prefix: str = MARKER_PREFIX
    skip_same: bool = True
    skip_higher: bool = True
    tiers: Mapping[str, int] = field(default_factory=lambda: dict(MODEL_TIERS))

    @property
    def marker(self) -> str:
        return model_marker(self.model, self.marker_template)


def tags_of_service(file_tags: DataFrame, service_key: str | None = "") -> DataFrame:
    """Rows of one tag service, or all rows when the key is blank."""
    key = (service_key or "").strip()
    return file_tags.where(F.col("service_key") == key) if key else file_tags


def marker_present(
    files: DataFrame, file_tags: DataFrame, marker: str, service_key: str = ""
) -> DataFrame:
    """Files that carry the marker on the service, or on any service when the key is blank."""
    needle = normalize_text(marker or "")
    if not needle:
        return files.limit(0)
    tagged = tags_of_service(file_tags, service_key).where(F.col("tag_norm") == needle)
    return files.join(tagged.select("file_id").distinct(), "file_id", "left_semi")


def max_marker_tier(
    file_tags: DataFrame,
    service_key: str = "",
    prefix: str = MARKER_PREFIX,
    tiers: Mapping[str, int] = MODEL_TIERS,
) -> DataFrame:
    """Highest ranked marker per file: file_id, tier, slug. Files without a ranked marker are absent.

    Of equal ranks the first one wins, in (service, status, position, text) order.
    """
    ranked = (
        tags_of_service(file_tags, service_key)
        .where(may_be_marker("tag_norm", prefix))
        .select("file_id", "service_key", "status", "pos", "tag", marker_slug("tag", prefix).alias("slug"))
        .select("*", (-model_tier("slug", tiers)).alias("rank"))
    )
    best = F.min(F.struct("rank", "service_key", "status", "pos", "tag", "slug"))
    return (
        ranked.groupBy("file_id")
        .agg(best.alias("best"))
        .where(F.col("best.rank") < 0)
        .select("file_id", (-F.col("best.rank")).alias("tier"), F.col("best.slug").alias("slug"))
    )


def file_facts(files: DataFrame, file_tags: DataFrame, rules: SkipRules, hot: Column | None = None):
    """One row per file: is it known, does it carry the run's marker, its highest rank.

    Known files and marker tags go through one aggregation, so both reach the queue with a single
    shuffle. Only marker tags leave the scan.
    """
    current = normalize_text(rules.marker)
    same = F.col("tag_norm") == current if current else F.lit(False)
    of_interest = may_be_marker("tag_norm", rules.marker_prefix)
    if current and not current.startswith(normalize_text(marker_start(rules.marker_prefix))):
        of_interest = of_interest | same
    marked = (
        tags_of_service(file_tags, rules.service_key)
        .where(of_interest)
        .select("file_id", same.cast("int").alias("same"), marker_slug("tag", rules.marker_prefix).alias("slug"))
        .select("file_id", F.lit(0).alias("known"), "same", model_tier("slug", rules.tiers).alias("tier"))
    )
    known = files.select("file_id", F.lit(1).alias("known"), F.lit(0).alias("same"), F.lit(0).alias("tier"))
    facts = known.unionByName(marked)
    keys = ["file_id"]
    if hot is not None:
        facts, keys = repeat_rows(facts, "file_id", hot), ["file_id", SALT]
    return facts.groupBy(*keys).agg(
        F.max("known").alias("known"), F.max("same").alias("same"), F.max("tier").alias("tier")
    )


def _decided(joined: DataFrame, rules: SkipRules) -> DataFrame:
    known = F.coalesce(F.col("known"), F.lit(0)) > 0
    same = known & (F.col("same") > 0) & F.lit(rules.skip_same and bool(rules.marker))
    higher = (
        known & (F.col("tier") > F.lit(tier_of(rules.model, rules.tiers))) & F.lit(rules.skip_higher)
    )
    return joined.withColumn(
        "skip_reason", F.when(same, F.lit(SKIP_SAME_MARKER)).when(higher, F.lit(SKIP_HIGHER_TIER))
    ).withColumn("missing", ~known).drop("known", "same", "tier")


def skip_decisions(
    queue: DataFrame, files: DataFrame, file_tags: DataFrame, rules: SkipRules = SkipRules()
) -> DataFrame:
    """Queue rows plus `skip_reason` (null = score it) and `missing` (no metadata, so score it).

    The same marker is tested before the higher rank. A file may stand in the queue many times.
    """
    hot = hot_keys(queue, "file_id")
    facts = file_facts(files, file_tags, rules, hot)
    joined = salt_rows(queue, "file_id", hot, "pos").join(facts, ["file_id", SALT], "left").drop(SALT)
    return _decided(joined, rules)


def queue_plan(
    queue: DataFrame, files: DataFrame, file_tags: DataFrame, rules: SkipRules = SkipRules()
) -> DataFrame:
    """One row: total, infer (missing files included), both kinds of skips, missing metadata.

    Repeated ids are counted before the join, so the join sees each id once.
    """
    ids = queue.groupBy("file_id").agg(F.count("*").alias("n"))
    joined = ids.join(file_facts(files, file_tags, rules), "file_id", "left")
    return plan_counts(_decided(joined, rules), F.col("n"))


def plan_counts(decisions: DataFrame, weight: Column | int = 1) -> DataFrame:
    """Plan counts of decided rows, each counted `weight` times."""
    weight = F.lit(weight)

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0)).cast("bigint")

    return decisions.agg(
        F.coalesce(F.sum(weight), F.lit(0)).cast("bigint").alias("queue_total"),
        total(F.col("skip_reason").isNull()).alias("infer_total"),
        total(F.col("skip_reason") == SKIP_SAME_MARKER).alias("skip_same_marker"),
        total(F.col("skip_reason") == SKIP_HIGHER_TIER).alias("skip_higher_tier"),
        total(F.col("missing")).alias("missing_metadata"),
    )


def bucket_of(skip_reason: Column | str = "skip_reason") -> Column:
    """0 score, 1 same marker, 2 higher rank."""
    reason = F.col(skip_reason) if isinstance(skip_reason, str) else skip_reason
    return (
        F.when(reason == SKIP_SAME_MARKER, F.lit(1)).when(reason == SKIP_HIGHER_TIER, F.lit(2)).otherwise(F.lit(0))
    )


def reorder_infer_first(decisions: DataFrame) -> DataFrame:
    """Adds `bucket` and the dense `ordinal` of the run order: to score, same marker, higher rank."""
    return with_ordinal(
        decisions.withColumn("bucket", bucket_of()), "pos", major=["bucket"]
    )


def attach_metadata(queue: DataFrame, files: DataFrame) -> DataFrame:
    """Queue rows with their file columns; `missing_metadata` marks ids without any."""
    known = files.withColumn("_known", F.lit(True))
    return lookup_join(queue, known, "file_id", "pos").withColumn(
        "missing_metadata", F.col("_known").isNull()
    ).drop("_known")


def merge_prefetch(queue: DataFrame, prefetched: DataFrame, source: DataFrame) -> DataFrame:
    """Metadata of every queued file: prefetched rows first, the rest from the source.

    All three are dealt by id into the same tasks, each of a bounded number of rows. A semi join
    looks for one match only, so a file that is queued very often needs no grouping.
    """
    n = tasks_for(queue, prefetched, source)
    wanted, prefetched, source = (t.repartition(n, "file_id") for t in (queue.select("file_id"), prefetched, source))
    ready = prefetched.join(wanted, "file_id", "left_semi")
    fetched = source.join(wanted, "file_id", "left_semi").join(prefetched.select("file_id"), "file_id", "left_anti")
    return ready.withColumn("origin", F.lit("prefetch")).unionByName(
        fetched.withColumn("origin", F.lit("source"))
    )


def validate_queue(raw: DataFrame, column: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """(ok, rejects) of requested ids given as text.

    One unreadable id rejects the request, so `ok` is then empty. An empty request is rejected as
    `empty_queue`. Rejects: code, rows.
    """
    number = strip(F.col(column).cast("string")).try_cast("bigint")
    counts = raw.agg(F.count("*").alias("n"), F.count_if(number.isNull()).alias("bad"))
    code = F.when(F.col("n") == 0, F.lit("empty_queue")).when(F.col("bad") > 0, F.lit("invalid_request"))
    rejects = counts.select(code.alias("code"), F.col("bad").alias("rows")).where(F.col("code").isNotNull())
    clean = counts.select(F.col("bad") == 0).scalar()
    ok = raw.withColumn(column, number).where(clean)
    return ok, rejects

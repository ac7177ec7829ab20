"""Mixing the texts of several services to target weights by weighted fair queueing.

Each service's files stand in a shuffled queue. A file finishes when the words of its service up
to and including it, divided by the service's weight, have gone by. Sorting all files by that
time serves every service at the rate of its weight; the mix is cut where its budget is used up.
A service whose files run out is served from the start again until it has given `max_repeats`
times its size, and the others share what is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagspark.llm.texts import word_count
from tagspark.operators.ordered import range_totals
from tagspark.session import cut_lineage

WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MAX_REPEATS = 2
SEED = "mix-1"


def service_targets(
    sized: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget_share: float = BUDGET_SHARE,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """One row per service: service_key, place, weight, source_size, target.

    Services stand in order of their key's code points, a null key last, and take the weights in
    turn. The budget is `budget_share` of all words. It is shared by weight; no target exceeds
    `max_repeats` times its service's size, and what is cut off is shared among the others. Windows
    here see one row per service.
    """
    place = Window.orderBy(F.col("service_key").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    services = (
        sized.groupBy("service_key")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(place) - 1)
        .withColumn("weight", weight)
        .withColumn("_limit", max_repeats * F.col("source_size"))
    )
    # The level is what a weight of one gets. Services are filled in order of limit per weight;
    # the first that stays below its limit when all later ones get the same level sets it.
    filling = Window.orderBy(F.col("_limit") / F.col("weight"), "place")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(float(budget_share))
    left = budget - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    levels = services.withColumn("_level", left / F.sum("weight").over(after))
    open_ = F.when(F.col("_level") * F.col("weight") <= F.col("_limit"), F.col("_level"))
    level = F.first(open_, ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("_limit").cast("double"), F.coalesce(level * F.col("weight"), F.col("_limit").cast("double")))
    return levels.select("service_key", "place", "weight", "source_size", target.alias("target"))


def fair_mix(
    files: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget_share: float = BUDGET_SHARE,
    max_repeats: int = MAX_REPEATS,
    seed: str = SEED,
    key: str | None = None,
) -> DataFrame:
    """Every row of `files` (file_id, service_key, tag_text) with how much of it the mix takes.

    Returns file_id, service_key, size (words), source_size and target (of its service), times (how
    often the mix holds the file, up to `max_repeats`) and taken (words, repeats counted). The order of a service's
    files depends on `file_id` and `seed` only, so reruns agree. If `key` names a column of whole
    numbers, it is returned too.

    A null text has no words, a null service is one of its own, a null `file_id` is a file like
    any other. Rows that are alike in file, service and text are interchangeable; each is a file of
    its own. An empty table gives an empty mix. Further columns are ignored.

    Prefix sums run over ranges of the sort keys, so a service with most files is many ranges.
    """
    sized = cut_lineage(_sized(files, seed, key), "sized-files")
    targets = cut_lineage(service_targets(sized, weights, budget_share, max_repeats), "service-targets")
    placed = sized.join(
        targets.withColumnRenamed("service_key", "_service"), F.col("service_key").eqNullSafe(F.col("_service"))
    ).drop("_service")

    queue = ["place", "shuffled", "row"]
    served = range_totals(placed, queue[1:], {"served": F.col("size")}, group=["place"])
    served = cut_lineage(served, "served")
    # A file that is taken again stands behind the whole of its service.
    copies = served.select(
        *queue,
        "size",
        F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("again"),
        "source_size",
        "served",
        "weight",
    ).withColumn("finish", (F.col("again") * F.col("source_size") + F.col("served")) / F.col("weight"))
    order = ["finish", "place", "again", "shuffled", "row"]
    mixed = range_totals(copies.select(*order, "size"), order, {"total": F.col("size")})
    budget = targets.agg(F.sum("source_size") * F.lit(float(budget_share))).scalar()
    last = mixed.where(F.col("total") <= budget).agg(F.max(F.struct(*order)).alias("last"))
    last = cut_lineage(last, "mix-end").select("last").scalar()

    def times(again: int) -> Column:
        finish = (again * F.col("source_size") + F.col("served")) / F.col("weight")
        at = F.struct(finish.alias("finish"), "place", F.lit(again).alias("again"), "shuffled", "row")
        return F.when(at <= last, F.lit(1)).otherwise(F.lit(0))

    total = times(0)
    for again in range(1, max_repeats):
        total = total + times(again)
    rows = served.withColumn("times", total.cast("int"))
    return rows.select(
        "file_id",
        "service_key",
        "size",
        "source_size",
        "target",
        "times",
        (F.col("times") * F.col("size")).alias("taken"),
        *([F.col("row").alias(key)] if key else []),
    )


def _sized(files: DataFrame, seed: str, key: str | None) -> DataFrame:
    """Sizes, the place in the shuffled queue, and a number that tells equal rows apart."""
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), F.col("file_id").cast("string")))
    return files.select(
        "file_id",
        F.col("service_key").cast("string").alias("service_key"),
        word_count().alias("size"),
        shuffled.alias("shuffled"),
        (F.col(key) if key else F.monotonically_increasing_id()).alias("row"),
    )

"""Browsing: search, pages, ranges, per-service tag views, neighbours, previews."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagspark.defaults import PAGE_SIZE
from tagspark.functions.text import normalize_text, service_label
from tagspark.operators.ordered import neighbours_of, with_ordinal
from tagspark.operators.pages import PageIndex
from tagspark.operators.skew import lookup_join

PREVIEW_IDS = 500
_SIZE_UNITS = {"b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3, "tb": 1024**4}
_SIZE_TERM = re.compile(r"system:filesize\s*(<=|>=|<|>|=)\s*([0-9.]+)\s*([kmgt]?b)", re.IGNORECASE)
_TYPE_TERM = re.compile(r"system:filetype is (\S+)", re.IGNORECASE)


def system_predicate(term: str) -> Column | None:
    """Column for a `system:` search term over file columns, or None for a tag term."""
    text = term.strip()
    if text.lower() in ("system:archive", "system:inbox"):
        return F.col("state") == text.lower().split(":")[1]
    kind = _TYPE_TERM.fullmatch(text)
    if kind:
        wanted = kind.group(1).lower()
        mime = F.lower(F.trim("mime"))
        return mime == wanted if "/" in wanted else F.startswith(mime, F.lit(wanted + "/"))
    size = _SIZE_TERM.fullmatch(text)
    if size:
        sign, number, unit = size.groups()
        limit = F.lit(float(number) * _SIZE_UNITS[unit.lower()])
        value = F.col("size")
        return {"<": value < limit, "<=": value <= limit, ">": value > limit, ">=": value >= limit, "=": value == limit}[sign]
    if text.lower().startswith("system:"):
        raise ValueError(f"unknown search term: {term}")
    return None


def search_files(
    files: DataFrame, file_tags: DataFrame, terms: Sequence[str], sort: str | None = None, asc: bool = True
) -> DataFrame:
    """Files for which every term holds; `-tag` excludes. `sort` names a file column.

    System terms go to the file scan. All tag terms are tested in one pass over the tags: only
    rows with a searched tag leave the scan, and files meet one row of flags.
    """
    found = files
    positive, negative = [], []
    for term in (t.strip() for t in terms):
        if not term:
            continue
        predicate = system_predicate(term[1:] if term.startswith("-system:") else term)
        if predicate is not None:
            keep = F.coalesce(predicate, F.lit(False))
            found = found.where(~keep if term.startswith("-") else keep)
        elif term.startswith("-"):
            negative.append(normalize_text(term[1:]))
        else:
            positive.append(normalize_text(term))
    searched = sorted({*positive, *negative})
    if searched:
        tagged = file_tags.where(F.col("tag_norm").isin(*searched))
        flags = tagged.groupBy("file_id").agg(
            *[F.max((F.col("tag_norm") == t).cast("int")).alias(f"_t{i}") for i, t in enumerate(searched)]
        )
        holds = F.lit(True)
        for i, t in enumerate(searched):
            if t in positive:
                holds = holds & (F.col(f"_t{i}") == 1)
            if t in negative:
                holds = holds & (F.coalesce(f"_t{i}", F.lit(0)) == 0)
        if positive:
            found = found.join(flags.where(holds).select("file_id"), "file_id", "left_semi")
        else:
            found = found.join(flags.where(~holds).select("file_id"), "file_id", "left_anti")
    if sort is None:
        return found
    order = F.col(sort).asc_nulls_last() if asc else F.col(sort).desc_nulls_last()
    return found.orderBy(order, "file_id")


def paginate(df: DataFrame, order: Sequence[str | Column], page: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page (from 0) of an ordered table, for the first few; deep ones take a `PageIndex`."""
    return df.orderBy(*order).offset(page * size).limit(size)


def select_range(ordered: DataFrame, a: int, b: int) -> DataFrame:
    """Rows whose position lies between two positions, both included, in either direction."""
    return ordered.where(F.col("pos").between(min(a, b), max(a, b)))


def select_page(
    ordered: DataFrame | PageIndex, selected: DataFrame, page: int, size: int = PAGE_SIZE
) -> DataFrame:
    """The selection plus every id on the page, of a table ordered by `pos` or of its index."""
    rows = ordered.page(page, size) if isinstance(ordered, PageIndex) else paginate(ordered, ["pos"], page, size)
    return selected.select("file_id").union(rows.select("file_id")).distinct()


def ordered_selection(ordered: DataFrame, selected: DataFrame) -> DataFrame:
    """Queue rows of selected files, positions kept."""
    return lookup_join(ordered, selected.select("file_id").distinct(), "file_id", "pos", "left_semi")


def prune_metadata(files: DataFrame, page: DataFrame, selected: DataFrame) -> DataFrame:
    """File rows of the visible page and of the selection."""
    keep = page.select("file_id").union(selected.select("file_id")).distinct()
    return files.join(keep, "file_id", "left_semi")


def neighbours(ordered: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Previous and next file of each row: file_id, pos, previous, next.

    Over the whole order the ends point at themselves. Inside a selection of several files the
    order is that of the selection and the ends wrap around.
    """
    if selected is None:
        rows = neighbours_of(ordered.select("file_id", "pos"), "pos", "file_id")
        return rows.select(
            "file_id",
            "pos",
            F.coalesce("previous", "file_id").alias("previous"),
            F.coalesce("next", "file_id").alias("next"),
        )
    chosen = ordered_selection(ordered, selected).select("file_id", "pos")
    first = chosen.agg(F.min_by("file_id", "pos")).scalar()
    last = chosen.agg(F.max_by("file_id", "pos")).scalar()
    rows = neighbours_of(chosen, "pos", "file_id")
    return rows.select(
        "file_id", "pos", F.coalesce("previous", last).alias("previous"), F.coalesce("next", first).alias("next")
    )


def first_seen_tags(file_tags: DataFrame) -> DataFrame:
    """Distinct tags (exact text) per file and service with the place where each first appears."""
    place = F.min(F.struct("status", "pos")).alias("place")
    return file_tags.groupBy("file_id", "service_key", "tag").agg(place).select(
        "file_id", "service_key", "tag", F.col("place.status").alias("status"), F.col("place.pos").alias("pos")
    )


def tag_counts(file_tags: DataFrame) -> DataFrame:
    """Number of distinct tags per file and service."""
    distinct = file_tags.select("file_id", "service_key", "tag").distinct()
    return distinct.groupBy("file_id", "service_key").agg(F.count("*").alias("tags"))


def with_service_name(rows: DataFrame, services: DataFrame) -> DataFrame:
    """Adds `service_name`. The service list is small, and Spark broadcasts it when it is."""
    named = services.select("service_key", F.col("name").alias("_name"))
    return rows.join(named, "service_key", "left").withColumn(
        "service_name", service_label("_name", "service_key")
    ).drop("_name")


def top_tags(file_tags: DataFrame, n: int) -> DataFrame:
    """First `n` distinct tags per file and service in seen order: adds `rank` from 1.

    The rank limit is applied before the shuffle, so a task sends at most `n` rows per group.
    """
    seen = Window.partitionBy("file_id", "service_key").orderBy("status", "pos", "tag")
    return (
        first_seen_tags(file_tags)
        .withColumn("rank", F.row_number().over(seen))
        .where(F.col("rank") <= n)
        .select("file_id", "service_key", "tag", "rank")
    )


def recovery_snapshot(
    ordered: DataFrame, results: DataFrame, pending: DataFrame, preview: int = PREVIEW_IDS
) -> DataFrame:
    """One row: counts of pending writes and of unprocessed queue rows, with the first ids of each.

    Queue rows are processed in order, so with m results the rows from ordinal m on remain.
    `results` and `pending` hold one row per result; `pending` has pos and file_id.
    """
    done = results.agg(F.count("*").alias("n"))
    rest = ordered.where(F.col("ordinal") >= done.scalar())

    def first_ids(rows: DataFrame, by: str) -> DataFrame:
        head = rows.orderBy(by).limit(preview)
        ids = F.array_sort(F.collect_list(F.struct(by, "file_id")))
        return head.agg(F.transform(ids, lambda r: r["file_id"]).alias("ids"))

    counts = ordered.agg(F.count("*").alias("total_queue"))
    return counts.select(
        pending.agg(F.count("*")).scalar().alias("pending_commit_count"),
        first_ids(pending, "pos").scalar().alias("pending_commit_file_ids"),
        rest.agg(F.count("*")).scalar().alias("remaining_infer_count"),
        first_ids(rest, "ordinal").scalar().alias("remaining_infer_file_ids"),
        done.scalar().alias("inferred_so_far"),
        "total_queue",
    )


def run_order(ordered: DataFrame) -> DataFrame:
    """Queue rows with a dense ordinal by position."""
    return with_ordinal(ordered, "pos")

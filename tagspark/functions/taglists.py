"""Row-local functions over tag arrays. None of them shuffles or leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagspark.defaults import (
    CHARACTER_PREFIX,
    GENERAL_PREFIX,
    MARKER_PREFIX,
    RATING_PREFIX,
)
from tagspark.functions.text import _col, is_blank, normalize_tag, normalize_text

_NO_TAGS = "array<string>"


def contains_tag(tags: Column | str, needle: str) -> Column:
    """True if any entry equals the needle in normal form; a blank needle is never found."""
    wanted = normalize_text(needle or "")
    if not wanted:
        return F.lit(False)
    return F.coalesce(F.exists(_col(tags), lambda t: normalize_tag(t) == wanted), F.lit(False))


def dedupe_markers(tags: Column | str, canonical: str, prefix: str = MARKER_PREFIX) -> Column:
    """struct(tags, removed): only the canonical marker stays, once, at its first slot or at the end.

    Blank entries go too. The list is returned as it is when the canonical marker is blank or does
    not carry the prefix.
    """
    tags = _col(tags)
    marker = (canonical or "").strip()
    current, start = normalize_text(marker), normalize_text(prefix)
    if not marker or not current.startswith(start):
        return F.struct(tags.alias("tags"), F.lit(0).alias("removed"))

    kept = F.filter(tags, lambda t: ~is_blank(t))
    keys = F.transform(kept, normalize_tag)
    slot = F.array_position(keys, current)
    markers = F.size(F.filter(keys, lambda k: F.startswith(k, F.lit(start))))
    found = F.when(slot > 0, F.lit(1)).otherwise(F.lit(0))
    cleaned = F.filter(
        F.transform(
            kept,
            lambda t, i: F.when(i + 1 == slot, F.lit(marker)).when(
                ~F.startswith(normalize_tag(t), F.lit(start)), t
            ),
        ),
        lambda t: t.isNotNull(),
    )
    result = F.when(slot > 0, cleaned).otherwise(F.concat(cleaned, F.array(F.lit(marker))))
    return F.struct(result.alias("tags"), (markers - found).alias("removed"))


def format_tags(
    general: Column | str,
    character: Column | str,
    rating: Column | str,
    general_prefix: str = GENERAL_PREFIX,
    character_prefix: str = CHARACTER_PREFIX,
    rating_prefix: str = RATING_PREFIX,
) -> Column:
    """Flat tag list of one prediction: general, character, then the top rating.

    Inputs are arrays of struct(tag, conf) ordered by falling confidence, so the top rating is the
    first one. Only general and character names trade underscores for spaces.
    """

    def names(column: Column | str, prefix: str) -> Column:
        return F.transform(
            F.coalesce(_col(column), F.array().cast("array<struct<tag:string,conf:double>>")),
            lambda p: F.concat(F.lit(prefix or ""), F.translate(p["tag"], "_", " ")),
        )

    top = F.transform(
        F.slice(F.coalesce(_col(rating), F.array().cast("array<struct<tag:string,conf:double>>")), 1, 1),
        lambda p: F.concat(F.lit(rating_prefix or ""), p["tag"]),
    )
    return F.concat(names(general, general_prefix), names(character, character_prefix), top)


def result_tags(
    tags: Column | str,
    formatted: Column | str,
    general: Column | str,
    character: Column | str,
    rating: Column | str,
    **prefixes: str,
) -> Column:
    """First non-empty of the stored tags, the stored formatted tags and a fresh `format_tags`."""
    return (
        F.when(F.size(_col(tags)) > 0, _col(tags))
        .when(F.size(_col(formatted)) > 0, _col(formatted))
        .otherwise(format_tags(general, character, rating, **prefixes))
    )


def merge_suggestions(draft: Column | str, predicted: Column | str) -> Column:
    """Predicted tags missing from the draft, each once, in predicted order; exact text."""
    empty = F.array().cast(_NO_TAGS)
    return F.array_except(F.coalesce(_col(predicted), empty), F.coalesce(_col(draft), empty))

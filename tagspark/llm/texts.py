"""The texts that these operators work on: all tags of a file, one per line.

A file's record has `file_id`, `tag_text` and, where an operator needs it, the `service_key` that
the tags come from. Such a text is what a captioning or tagging model is trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
GAP = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(column: str = "tag_text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "tag_text") -> Column:
    """Number of words of a text as long; a null text has none."""
    return F.regexp_count(whole_text(column), F.lit(WORD)).cast("bigint")


def tag_texts(file_tags: DataFrame) -> DataFrame:
    """One row per file and service with its tags in list order, one per line.

    A file's tags of one service are one record of the library, so they fit in a row. Null tags
    are left out; a file whose tags are all null has an empty text.
    """
    listed = F.sort_array(F.collect_list(F.struct("pos", "tag")))
    return (
        file_tags.groupBy("file_id", "service_key")
        .agg(listed.alias("_tags"))
        .select(
            "file_id",
            "service_key",
            F.array_join(F.transform("_tags", lambda t: t["tag"]), "\n").alias("tag_text"),
        )
    )

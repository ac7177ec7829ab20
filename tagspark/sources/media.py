"""Media bytes and the choice of what to read for scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagspark.functions.text import strip


def read_media(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, name, length, modificationTime, content); name is the file name without extension."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return reader.load(path).select("path", stem.alias("name"), "length", "modificationTime", "content")


def media_route(mime: Column | str) -> Column:
    """`thumbnail` for video, else `full` (with the thumbnail to fall back on)."""
    kind = F.lower(strip(mime))
    is_video = F.coalesce(F.startswith(kind, F.lit("video/")), F.lit(False))
    return F.when(is_video, F.lit("thumbnail")).otherwise(F.lit("full"))


def route_media(files: DataFrame) -> DataFrame:
    """Adds `route`, so that only the bytes that are needed are read."""
    return files.withColumn("route", media_route("mime"))


def pick_raster(routed: DataFrame, full: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """Adds `content`: full bytes, else thumbnail bytes; files with neither drop out.

    `full` and `thumbnails` hold (file_id, content), null where the bytes cannot be decoded.
    """
    images = routed.where(F.col("route") == "full").join(
        full.select("file_id", F.col("content").alias("_full")), "file_id", "left"
    )
    videos = routed.where(F.col("route") == "thumbnail").withColumn("_full", F.lit(None).cast("binary"))
    both = images.unionByName(videos).join(
        thumbnails.select("file_id", F.col("content").alias("_thumb")), "file_id", "left"
    )
    return both.withColumn("content", F.coalesce("_full", "_thumb")).where(
        F.col("content").isNotNull()
    ).drop("_full", "_thumb")

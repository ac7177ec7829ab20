"""Library metadata: nested JSON to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagspark.functions.text import is_blank, normalize_tag, strip

_OBJECT = "map<string,variant>"
_FILE_FIELDS = {
    "hash": "string",
    "size": "bigint",
    "mime": "string",
    "width": "int",
    "height": "int",
    "has_audio": "boolean",
    "ext": "string",
}


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def parse_metadata(rows: DataFrame, text: str = "value") -> DataFrame:
    """JSON text rows to (file_id, pos, meta). Rows without a readable integer id are dropped.

    Numbers are cut to integers, flags count as 0 and 1, text must be an integer once stripped.
    """
    parsed = rows.withColumn("meta", F.try_parse_json(text))
    key = F.try_variant_get("meta", "$.file_id", "variant")
    digits = strip(F.try_variant_get("meta", "$.file_id", "string"))
    grouped = F.rlike(digits, F.lit(r"^[+-]?\d+(_\d+)*$"))
    from_text = F.when(grouped, F.replace(digits, F.lit("_"), F.lit("")).try_cast("bigint"))
    number = F.when(_kind(key) == "STRING", from_text).otherwise(
        F.try_variant_get("meta", "$.file_id", "bigint")
    )
    keep = [c for c in rows.columns if c != text]
    # A row without an id yields no entry. Unlike a filter this is not moved below the parsing,
    # where it would parse every text again.
    entry = F.when(number.isNotNull(), F.array(F.struct(number.alias("file_id"), "meta")))
    return parsed.select(*keep, F.inline(entry))


def last_by_id(rows: DataFrame, order: str = "pos", key: str = "file_id") -> DataFrame:
    """The last row per id. An id that repeats very often is folded before the shuffle."""
    others = [c for c in rows.columns if c not in (key, order)]
    last = F.max_by(F.struct(order, *others), order).alias("_last")
    picked = rows.where(F.col(key).isNotNull()).groupBy(key).agg(last)
    return picked.select(*[F.col(key) if c == key else F.col(f"_last.{c}").alias(c) for c in rows.columns])


def read_file_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(files, raw) from text files with one metadata object per line.

    Line order decides between rows with one id; `pos` orders by file name, block, then line.
    """
    lines = spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path"),
            F.col("_metadata.file_block_start"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("pos"),
    )
    raw = last_by_id(parse_metadata(lines)).drop("pos")
    return file_rows(raw), raw


def file_rows(raw: DataFrame) -> DataFrame:
    """Flat file columns of parsed metadata; an unreadable value is null."""
    fields = [F.try_variant_get("meta", f"$.{n}", kind).alias(n) for n, kind in _FILE_FIELDS.items()]
    return raw.select("file_id", *fields)


def _object(column: str, path: str = "$") -> Column:
    return F.try_variant_get(column, path, _OBJECT)


def explode_storage_tags(
    raw: DataFrame, service_key: str | None = None, tag_set: str = "storage_tags"
) -> DataFrame:
    """(file_id, service_key, tag_set, status, pos, tag, tag_norm) of parsed metadata.

    A malformed service, tag set, list or entry is left out without touching what stands beside
    it. All statuses are kept. Blank tags are dropped.
    """
    services = raw.select("file_id", F.explode(_object("meta", "$.tags")).alias("service_key", "block"))
    if service_key:
        services = services.where(F.col("service_key") == service_key)
    statuses = services.select(
        "file_id", "service_key", F.explode(_object("block", f"$.{tag_set}")).alias("status", "list")
    )
    entries = statuses.select(
        "file_id",
        "service_key",
        "status",
        F.posexplode(F.try_variant_get("list", "$", "array<variant>")).alias("pos", "entry"),
    )
    return (
        entries.where(_kind(F.col("entry")) == "STRING")
        .select(
            "file_id",
            "service_key",
            F.lit(tag_set).alias("tag_set"),
            "status",
            F.col("pos").cast("bigint").alias("pos"),
            F.variant_get("entry", "$", "string").alias("tag"),
        )
        .where(~is_blank("tag"))
        .withColumn("tag_norm", normalize_tag("tag"))
    )


def explode_view_tags(raw: DataFrame) -> DataFrame:
    """Tags as a viewer shows them: (file_id, service_key, status, pos, tag).

    The tag root is `tags`, else the older display root; inside a service the stored set comes
    before the display set, and a service without either is itself read as status lists.
    """
    root = F.coalesce(_object("meta", "$.tags"), _object("meta", "$.service_keys_to_statuses_to_display_tags"))
    services = raw.select("file_id", F.explode(root).alias("service_key", "block"))
    lists = F.coalesce(_object("block", "$.storage_tags"), _object("block", "$.display_tags"), _object("block"))
    statuses = services.select("file_id", "service_key", F.explode(lists).alias("status", "list"))
    entries = statuses.select(
        "file_id",
        "service_key",
        "status",
        F.posexplode(F.try_variant_get("list", "$", "array<variant>")).alias("pos", "entry"),
    )
    return entries.select(
        "file_id",
        "service_key",
        "status",
        F.col("pos").cast("bigint").alias("pos"),
        F.try_variant_get("entry", "$", "string").alias("tag"),
    ).where(F.col("tag").isNotNull())


def read_services(rows: DataFrame, text: str = "value") -> DataFrame:
    """(service_key, name, type, type_pretty) from JSON `{type name: [service, ...]}`.

    Values that are no lists and entries without a key are dropped.
    """
    types = rows.select(F.explode(_object_of(F.try_parse_json(text))).alias("type_name", "list"))
    entries = types.select(
        "type_name", F.explode(F.try_variant_get("list", "$", "array<variant>")).alias("entry")
    )

    def field(name: str, kind: str, default: Column) -> Column:
        return F.coalesce(F.try_variant_get("entry", f"$.{name}", kind), default).alias(name)

    has_key = F.map_contains_key(F.coalesce(_object("entry"), F.create_map().cast(_OBJECT)), F.lit("service_key"))
    return entries.where(has_key).select(
        field("service_key", "string", F.lit("")),
        field("name", "string", F.lit("")),
        field("type", "int", F.lit(0)),
        field("type_pretty", "string", F.col("type_name")),
    )


def _object_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", _OBJECT)

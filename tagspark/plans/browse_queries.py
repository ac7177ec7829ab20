"""Named queries: search and browsing, and reading nested library JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagspark.functions import taglists
from tagspark.operators import browse, diff
from tagspark.operators.pages import PageIndex
from tagspark.plans.library import Library
from tagspark.plans.registry import norm, part, query
from tagspark.sources import metadata

PAGE, PAGE_SIZE = 2, 50
DEEP_PAGE = 20
QUEUE_RANGE = 20_000

part("chosen", "SELECT file_id FROM files WHERE mime = 'video/mp4'", "files")
part("page", f"SELECT pos, file_id FROM queue ORDER BY pos LIMIT {PAGE_SIZE} OFFSET {PAGE * PAGE_SIZE}", "queue")


def chosen(lib: Library) -> DataFrame:
    """The selection of a user: all videos."""
    return lib.files.where("mime = 'video/mp4'").select("file_id")


@query(
    "files",
    "file_tags",
    sql="""SELECT file_id, size FROM files WHERE state = 'archive' AND lower(trim(mime)) LIKE 'image/%' AND size < 0.25 * 1024 * 1024
    AND file_id IN (SELECT file_id FROM file_tags WHERE tag_norm = 'red ring')
    AND file_id NOT IN (SELECT file_id FROM file_tags WHERE tag_norm = 'hot bolt')""",
)
def search_files(lib: Library) -> DataFrame:
    terms = ["system:archive", "system:filetype is image", "system:filesize < 0.25MB", "Red_Ring", "-hot bolt"]
    return browse.search_files(lib.files, lib.file_tags, terms, sort="size").select("file_id", "size")


@query(
    "files",
    "file_tags",
    sql="""SELECT file_id FROM files WHERE state = 'inbox' AND file_id NOT IN
    (SELECT file_id FROM file_tags WHERE tag_norm IN ('hot bolt', 'red ring'))""",
)
def search_excluding(lib: Library) -> DataFrame:
    return browse.search_files(lib.files, lib.file_tags, ["system:inbox", "-hot_bolt", "-red-ring"]).select("file_id")


@query("page", sql="SELECT pos, file_id FROM page")
def paginate(lib: Library) -> DataFrame:
    return PageIndex(lib.queue, ["pos"], range_rows=QUEUE_RANGE).page(PAGE, PAGE_SIZE)


@query("queue", sql=f"SELECT pos, file_id FROM queue ORDER BY pos DESC LIMIT {PAGE_SIZE} OFFSET {DEEP_PAGE * PAGE_SIZE}")
def paginate_deep(lib: Library) -> DataFrame:
    return PageIndex(lib.queue, [F.col("pos").desc()], range_rows=QUEUE_RANGE).page(DEEP_PAGE, PAGE_SIZE)


@query("queue", sql="SELECT pos, file_id FROM queue WHERE pos BETWEEN 40 AND 400")
def select_range(lib: Library) -> DataFrame:
    return browse.select_range(lib.queue, 400, 40)


@query("page", "chosen", sql="SELECT file_id FROM page UNION SELECT file_id FROM chosen")
def select_page(lib: Library) -> DataFrame:
    index = PageIndex(lib.queue, ["pos"], range_rows=QUEUE_RANGE)
    return browse.select_page(index, chosen(lib), PAGE, PAGE_SIZE)


@query("queue", "chosen", sql="SELECT pos, file_id FROM queue WHERE file_id IN (SELECT file_id FROM chosen)")
def ordered_selection(lib: Library) -> DataFrame:
    return browse.ordered_selection(lib.queue, chosen(lib))


@query(
    "files",
    "page",
    "chosen",
    sql="""SELECT file_id, hash, size FROM files WHERE file_id IN (SELECT file_id FROM page UNION SELECT file_id FROM chosen)""",
)
def prune_metadata(lib: Library) -> DataFrame:
    page = browse.paginate(lib.queue, ["pos"], PAGE, PAGE_SIZE)
    return browse.prune_metadata(lib.files, page, chosen(lib)).select("file_id", "hash", "size")


@query(
    "queue",
    sql="""SELECT file_id, pos, coalesce(lag(file_id) OVER w, file_id) AS previous, coalesce(lead(file_id) OVER w, file_id) AS next
    FROM queue WINDOW w AS (ORDER BY pos)""",
)
def neighbours(lib: Library) -> DataFrame:
    return browse.neighbours(lib.queue)


@query(
    "queue",
    "chosen",
    sql="""SELECT file_id, pos, coalesce(lag(file_id) OVER w, last_value(file_id) OVER f) AS previous,
    coalesce(lead(file_id) OVER w, first_value(file_id) OVER f) AS next FROM queue WHERE file_id IN (SELECT file_id FROM chosen)
    WINDOW w AS (ORDER BY pos), f AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def neighbours_selected(lib: Library) -> DataFrame:
    return browse.neighbours(lib.queue, chosen(lib))


part("base_tags", "SELECT DISTINCT file_id, trim(tag) AS tag FROM file_tags WHERE service_key = 'svc1'", "file_tags")
part("draft_tags", "SELECT file_id, replace(tag, '_', ' ') AS tag FROM proposed", "proposed")


@query(
    "base_tags",
    "draft_tags",
    sql="""(SELECT file_id, tag, 'add' AS action FROM draft_tags EXCEPT SELECT file_id, tag, 'add' FROM base_tags)
    UNION ALL (SELECT file_id, tag, 'remove' FROM base_tags EXCEPT SELECT file_id, tag, 'remove' FROM draft_tags)""",
)
def draft_diff(lib: Library) -> DataFrame:
    base = lib.file_tags.where("service_key = 'svc1'").select("file_id", F.trim("tag").alias("tag"))
    draft = lib.proposed.select("file_id", F.replace("tag", F.lit("_"), F.lit(" ")).alias("tag"))
    return diff.draft_diff(base, draft)


@query(
    sql="""SELECT doc_id, CASE WHEN source = lang THEN '' ELSE source END AS added FROM documents"""
)
def merge_suggestions(lib: Library) -> DataFrame:
    draft = F.array("lang", F.lit("en "))
    predicted = F.array("source", "lang", "source")
    added = F.array_join(taglists.merge_suggestions(draft, predicted), "|")
    return lib.table("documents").select("doc_id", added.alias("added"))


part(
    "halves",
    "SELECT *, row_number() OVER (ORDER BY pos) - 1 AS ordinal, file_id IN (SELECT file_id FROM chosen) AS pending FROM queue",
    "queue",
    "chosen",
)


@query(
    "halves",
    "files",
    sql="""SELECT (SELECT count(*) FROM halves WHERE pending) AS pending_commit_count,
    (SELECT string_agg(CAST(file_id AS STRING), ',' ORDER BY pos) FROM (SELECT * FROM halves WHERE pending ORDER BY pos LIMIT 500)) AS pending_ids,
    (SELECT count(*) FROM halves WHERE ordinal >= n) AS remaining_infer_count,
    (SELECT string_agg(CAST(file_id AS STRING), ',' ORDER BY pos) FROM (SELECT * FROM halves, (SELECT count(*) AS n FROM files) WHERE ordinal >= n ORDER BY pos LIMIT 500)) AS remaining_ids,
    n AS inferred_so_far, (SELECT count(*) FROM queue) AS total_queue FROM (SELECT count(*) AS n FROM files)""",
)
def recovery_snapshot(lib: Library) -> DataFrame:
    ordered = browse.run_order(lib.queue)
    pending = browse.ordered_selection(lib.queue, chosen(lib))
    snapshot = browse.recovery_snapshot(ordered, lib.files, pending)

    def joined(column: str):
        return F.array_join(F.transform(column, lambda i: i.cast("string")), ",")

    return snapshot.select(
        "pending_commit_count",
        joined("pending_commit_file_ids").alias("pending_ids"),
        "remaining_infer_count",
        joined("remaining_infer_file_ids").alias("remaining_ids"),
        "inferred_so_far",
        "total_queue",
    )


# ---- nested library JSON ---------------------------------------------------------------------
def metadata_json(lib: Library) -> DataFrame:
    """One metadata object per order, as text; some are malformed, some ids come twice or as text."""
    i = F.col("o_orderkey")
    file_id = (
        F.when(i % 10 == 1, F.concat(F.lit('" '), i.cast("string"), F.lit(' "')))
        .when(i % 10 == 2, F.concat(i.cast("string"), F.lit(".9")))
        .when(i % 10 == 3, F.lit('"not-int"'))
        .when(i % 10 == 4, (i - 4).cast("string"))
        .otherwise(i.cast("string"))
    )
    tags = F.format_string(
        '{"a":{"storage_tags":{"0":["Blue_Hair %d",%d,"  ","x-%s"],"1":"no list"}},"b":%s,"c":{"storage_tags":{"2":["%s"]}}}',
        i % 9,
        i,
        F.col("o_orderstatus"),
        F.when(i % 2 == 0, F.lit('"no object"')).otherwise(F.lit("null")),
        F.col("o_orderpriority"),
    )
    body = F.concat(
        F.lit('{"file_id":'),
        file_id,
        F.lit(',"hash":"h'),
        i.cast("string"),
        F.lit('","size":'),
        F.floor("o_totalprice").cast("string"),
        F.lit(',"mime":'),
        F.when(i % 3 == 0, F.lit("null")).otherwise(F.lit('"image/png"')),
        F.lit(',"tags":'),
        F.when(i % 5 == 0, F.lit("null")).otherwise(tags),
        F.lit("}"),
    )
    text = F.when(i % 50 == 6, F.lit("[1, 2]")).when(i % 50 == 7, F.lit("{broken")).otherwise(body)
    return lib.table("orders").select(text.alias("value"), i.alias("pos"))


part(
    "meta_rows",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos DESC) AS n FROM
    (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 10 = 4 THEN o_orderkey - 4 ELSE o_orderkey END AS file_id, o_orderkey AS i,
     o_totalprice, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 3 AND o_orderkey % 50 NOT IN (6, 7))) WHERE n = 1""",
)


def last_metadata(lib: Library) -> DataFrame:
    return metadata.last_by_id(metadata.parse_metadata(metadata_json(lib))).drop("pos")


@query(
    "meta_rows",
    sql="""SELECT file_id, 'h' || CAST(i AS STRING) AS hash, CAST(floor(o_totalprice) AS BIGINT) AS size,
    CASE WHEN i % 3 = 0 THEN NULL ELSE 'image/png' END AS mime, CAST(NULL AS INT) AS width FROM meta_rows""",
)
def read_file_metadata(lib: Library) -> DataFrame:
    return metadata.file_rows(last_metadata(lib)).select("file_id", "hash", "size", "mime", "width")


@query(
    "meta_rows",
    sql=f"""SELECT *, {norm('tag')} AS tag_norm FROM (
    SELECT file_id, 'a' AS service_key, '0' AS status, CAST(0 AS BIGINT) AS pos, 'Blue_Hair ' || CAST(i % 9 AS STRING) AS tag FROM meta_rows WHERE i % 5 <> 0
    UNION ALL SELECT file_id, 'a', '0', 3, 'x-' || o_orderstatus FROM meta_rows WHERE i % 5 <> 0
    UNION ALL SELECT file_id, 'c', '2', 0, o_orderpriority FROM meta_rows WHERE i % 5 <> 0)""",
)
def explode_storage_tags(lib: Library) -> DataFrame:
    return metadata.explode_storage_tags(last_metadata(lib)).drop("tag_set")


@query(
    sql="""SELECT o_orderkey AS file_id, 'a' AS service_key, '0' AS status, CAST(0 AS BIGINT) AS pos, o_orderstatus AS tag FROM orders WHERE o_orderkey % 4 = 0
    UNION ALL SELECT o_orderkey, 'a', '1', 0, o_orderpriority FROM orders WHERE o_orderkey % 4 = 1
    UNION ALL SELECT o_orderkey, 'b', '0', i, CASE i WHEN 0 THEN o_orderstatus ELSE o_orderpriority END FROM orders, (SELECT CAST(0 AS BIGINT) AS i UNION ALL SELECT 1)
    WHERE o_orderkey % 4 = 2"""
)
def view_tags(lib: Library) -> DataFrame:
    """Stored tags come before displayed ones, and the older display root is read where there are no tags."""
    kind = F.col("o_orderkey") % 4
    quoted = [F.concat(F.lit('"'), F.col(c), F.lit('"')) for c in ("o_orderstatus", "o_orderpriority")]
    stored = F.concat(F.lit('{"tags":{"a":{"storage_tags":{"0":['), quoted[0], F.lit(']},"display_tags":{"0":["other"]}}}}'))
    shown = F.concat(F.lit('{"tags":{"a":{"display_tags":{"1":['), quoted[1], F.lit("]}}}}"))
    older = F.concat(F.lit('{"service_keys_to_statuses_to_display_tags":{"b":{"0":['), quoted[0], F.lit(","), quoted[1], F.lit("]}}}"))
    text = F.when(kind == 0, stored).when(kind == 1, shown).when(kind == 2, older).otherwise(F.lit('{"tags":{"a":7}}'))
    raw = lib.table("orders").select(F.col("o_orderkey").alias("file_id"), F.parse_json(text).alias("meta"))
    return metadata.explode_view_tags(raw)


@query(
    sql="""SELECT 'svc' || CAST(n_nationkey AS STRING) AS service_key, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE n_name END AS name,
    n_regionkey AS type, 'kind ' || CAST(n_regionkey AS STRING) AS type_pretty FROM nation WHERE n_nationkey % 6 <> 5"""
)
def read_services(lib: Library) -> DataFrame:
    k = F.col("n_nationkey")
    entry = F.concat(
        F.lit("{"),
        F.when(k % 6 != 5, F.concat(F.lit('"service_key":"svc'), k.cast("string"), F.lit('",'))).otherwise(F.lit("")),
        F.when(k % 4 != 0, F.concat(F.lit('"name":"'), F.col("n_name"), F.lit('",'))).otherwise(F.lit("")),
        F.format_string('"type":%d}', "n_regionkey"),
    )
    body = F.concat(
        F.lit('{"kind '), F.col("n_regionkey").cast("string"), F.lit('":["no object",'), entry, F.lit('],"other":"no list"}')
    )
    return metadata.read_services(lib.table("nation").select(body.alias("value")))

"""Search, navigation, readers and writers."""

from __future__ import annotations

import json

import pytest
from conftest import got, table
from pyspark.sql import functions as F

from tagspark.functions.text import normalize_tag
from tagspark.operators import browse as B
from tagspark.sources import labels, media, metadata, runlogs

TAGS = "file_id bigint, service_key string, status string, pos bigint, tag string"


@pytest.fixture(scope="module")
def library(spark):
    files = table(
        spark, "file_id bigint, size bigint, mime string, state string",
        (1, 100, "image/png", "archive"), (2, 20 * 1024 * 1024, " Image/JPEG ", "archive"), (3, 5, "video/mp4", "inbox"), (4, None, None, None),
    )
    tags = table(
        spark, TAGS, (1, "s", "0", 0, "Character:Hatsune_Miku"), (2, "s", "0", 0, "blue hair"), (2, "t", "0", 1, "1girl"), (3, "s", "0", 0, "blue-hair")
    ).withColumn("tag_norm", normalize_tag("tag"))
    return files, tags


@pytest.mark.parametrize(
    "terms, found",
    [
        (["system:archive"], [1, 2]),
        (["system:inbox"], [3]),
        (["system:filetype is image"], [1, 2]),
        (["system:filetype is video/mp4"], [3]),
        (["system:archive", "-character:hatsune_miku"], [2]),
        (["system:filesize < 10MB"], [1, 3]),
        (["system:filesize >= 20 mb"], [2]),
        (["blue_hair"], [2, 3]),
        (["blue hair", "1girl"], [2]),
        (["blue hair", "-1girl"], [3]),
        (["-blue hair"], [1, 4]),
        (["-system:archive"], [3, 4]),
        ([" ", ""], [1, 2, 3, 4]),
        (["a", "-a"], []),
    ],
)
def test_search(library, terms, found):
    assert [r[0] for r in got(B.search_files(*library, terms), "file_id")] == found


def test_search_order_and_unknown_terms(library):
    ordered = B.search_files(*library, [], sort="size", asc=False)
    assert [r["file_id"] for r in ordered.collect()] == [2, 1, 3, 4]
    with pytest.raises(ValueError):
        B.search_files(*library, ["system:no such thing"])


def test_pages_ranges_and_neighbours(spark):
    order = table(spark, "pos bigint, file_id bigint", *[(i, 100 + i) for i in range(10)])
    chosen = table(spark, "file_id bigint", (103,), (107,), (109,), (999,))
    assert got(B.paginate(order, ["pos"], 1, 4), "file_id") == [(104,), (105,), (106,), (107,)]
    assert got(B.select_range(order, 7, 5), "file_id") == [(105,), (106,), (107,)]
    assert got(B.select_page(order, chosen, 0, 2)) == [(100,), (101,), (103,), (107,), (109,), (999,)]
    assert got(B.neighbours(order), "file_id", "previous", "next")[0] == (100, 100, 101)
    assert got(B.neighbours(order, chosen), "file_id", "previous", "next") == [(103, 109, 107), (107, 103, 109), (109, 107, 103)]
    assert got(B.prune_metadata(order, order.where("pos = 0"), chosen), "file_id") == [(100,), (103,), (107,), (109,)]


def test_recovery_snapshot(spark):
    order = B.run_order(table(spark, "pos bigint, file_id bigint", *[(i, 100 + i) for i in range(8)]))
    results = spark.range(5)
    pending = table(spark, "pos bigint, file_id bigint", (4, 104), (3, 103), (2, 102))
    row = B.recovery_snapshot(order, results, pending, preview=2).first()
    assert tuple(row) == (3, [102, 103], 3, [105, 106], 5, 8)


def test_tags_by_service(spark):
    tags = table(spark, TAGS, (1, "s", "0", 0, "b"), (1, "s", "0", 1, "a"), (1, "s", "1", 0, "b"), (1, "0123456789", "0", 0, "c"))
    services = table(spark, "service_key string, name string", ("s", "mine"))
    assert got(B.with_service_name(B.tag_counts(tags), services), "service_name", "tags") == [("01234567...", 1), ("mine", 2)]
    assert got(B.top_tags(tags, 1), "service_key", "tag") == [("0123456789", "c"), ("s", "b")]


# ---- sources ----------------------------------------------------------------------------------
def raw_of(spark, *docs):
    rows = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "pos bigint, value string")
    return metadata.parse_metadata(rows)


@pytest.mark.parametrize(
    "value, wanted", [("42", 42), (" 7 ", 7), ("1_000", 1000), ("7.0", None), ("x", None), (7.9, 7), (True, 1), (-3, -3), (None, None), ([1], None)]
)
def test_file_id_is_read_like_an_integer(spark, value, wanted):
    assert got(raw_of(spark, {"file_id": value, "k": "v"}), "file_id") == ([] if wanted is None else [(wanted,)])


def test_last_row_per_id_wins(spark, tmp_path):
    raw = metadata.last_by_id(raw_of(spark, {"file_id": 1, "hash": "a"}, "[1]", {"file_id": "1", "hash": "b"}, "{bad", {"hash": "c"}))
    assert got(metadata.file_rows(raw), "file_id", "hash") == [(1, "b")]
    (tmp_path / "m.json").write_text('{"file_id": 1, "hash": "a"}\n{"file_id": 2, "width": 7}\n{"file_id": 1, "hash": "z", "size": 3}\n')
    files, _ = metadata.read_file_metadata(spark, str(tmp_path))
    assert got(files, "file_id", "hash", "size", "width") == [(1, "z", 3, None), (2, None, None, 7)]


def test_explode_storage_tags_drops_only_what_is_malformed(spark):
    good = {"deadbeef": {"storage_tags": {"0": ["blonde_hair", "1girl"], "1": ["bodysuit"]}, "display_tags": {}}}
    raw = raw_of(
        spark,
        {"file_id": 1, "tags": good},
        {"file_id": 2, "tags": None},
        {"file_id": 3},
        {"file_id": 4, "tags": {"svc": "not-dict", "a": {"storage_tags": {"0": "nolist", "1": ["ok", 5, None, " ", "_"]}}, "b": {"storage_tags": []}}},
    )
    assert got(metadata.explode_storage_tags(raw), "file_id", "service_key", "status", "tag_norm") == [
        (1, "deadbeef", "0", "1girl"), (1, "deadbeef", "0", "blonde hair"), (1, "deadbeef", "1", "bodysuit"), (4, "a", "1", ""), (4, "a", "1", "ok"),
    ]
    assert got(metadata.explode_storage_tags(raw, "a"), "tag") == [("_",), ("ok",)]


def test_explode_view_tags_reads_the_older_root(spark):
    raw = raw_of(
        spark,
        {"file_id": 1, "service_keys_to_statuses_to_display_tags": {"s": {"0": ["a"]}}},
        {"file_id": 2, "tags": {"s": {"display_tags": {"1": ["b"]}}}},
        {"file_id": 3, "tags": {"s": {"storage_tags": {"0": ["c"]}, "display_tags": {"0": ["d"]}}}},
    )
    assert got(metadata.explode_view_tags(raw), "file_id", "status", "tag") == [(1, "0", "a"), (2, "1", "b"), (3, "0", "c")]


def test_read_services(spark):
    doc = {"local": [{"service_key": "a", "name": "A", "type": 5, "type_pretty": "p"}, {"name": "no key"}, 3], "other": "x", "repo": [{"service_key": "b"}]}
    rows = spark.createDataFrame([(json.dumps(doc),)], "value string")
    assert got(metadata.read_services(rows)) == [("a", "A", 5, "p"), ("b", "", 0, "repo")]


def test_labels_and_their_checks(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text('tag_id,name,category,count\n0,gen0,0,1\n1,"a,""b""",4,1\n2,rate_safe,9,1\n')
    read = labels.read_labels(spark, str(path))
    assert got(read, "label_idx", "name", "category") == [(0, "gen0", 0), (1, 'a,"b"', 4), (2, "rate_safe", 9)]
    assert got(labels.check_labels(read)) == [("csv_too_few_rows:3",)]
    assert got(labels.check_labels(read.drop("name", "tag_id"))) == [("csv_missing_columns:['name', 'tag_id']",)]


def test_an_empty_label_file_has_no_header(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert got(labels.check_labels(labels.read_labels(spark, str(tmp_path / "empty.csv")))) == [("csv_missing_header",)]
    (tmp_path / "bare.csv").write_text("tag_id,name,category,count\n")
    assert got(labels.check_labels(labels.read_labels(spark, str(tmp_path / "bare.csv")))) == [("csv_too_few_rows:0",)]


@pytest.mark.parametrize("as_table", [False, True])
def test_unknown_models_are_only_that(spark, as_table):
    models = table(spark, "model string", ("a",), ("b",))
    listing = table(spark, "model string, file string, length bigint", ("a", "model.onnx", 10))
    manifests = table(spark, "model string, revision string, sizes map<string,bigint>", ("a", "r", {}), ("b", "r", {}))
    supported = table(spark, "model string", ("b",), ("b",), ("z",)) if as_table else ["b", "z"]
    rows = {r["model"]: r for r in labels.verify_artifacts(models, listing, manifests, supported=supported).collect()}
    assert (rows["a"]["ok"], rows["a"]["issues"], rows["a"]["manifest_present"], rows["a"]["local_revision"]) == (False, ["unknown_model"], False, None)
    assert (rows["b"]["issues"], rows["b"]["manifest_present"]) == (["missing_required_files"], True)


def test_verify_artifacts(spark):
    models = table(spark, "model string", ("good",), ("small",), ("absent",))
    listing = table(
        spark, "model string, file string, length bigint",
        ("good", "model.onnx", 2_000_000), ("good", "selected_tags.csv", 900), ("small", "model.onnx", 10), ("small", "selected_tags.csv", 20),
        ("absent", "model.onnx", 5_000_000),
    )
    docs = [
        {"model_name": "good", "revision_sha": "r1", "files": {"model.onnx": {"size": 2_000_000}, "selected_tags.csv": {}}},
        {"model_name": "small", "revision_sha": "", "files": {"model.onnx": {"size": 11}}},
    ]
    manifests = labels.read_manifests(spark.createDataFrame([(json.dumps(d),) for d in docs], "value string"))
    remote = table(spark, "model string, remote_revision string", ("good", "r2"), ("small", "r2"))
    rows = {r["model"]: r for r in labels.verify_artifacts(models, listing, manifests, remote=remote).collect()}
    assert (rows["good"]["ok"], rows["good"]["issues"], rows["good"]["stale"]) == (True, ["newer_revision_on_hub"], True)
    assert rows["small"]["issues"] == [
        "onnx_too_small:10", "csv_too_small:20", "size_mismatch_vs_manifest:model.onnx", "manifest_missing_revision_cannot_compare_hub",
    ]
    assert (rows["absent"]["ok"], rows["absent"]["issues"], rows["absent"]["manifest_present"]) == (False, ["missing_required_files"], False)


@pytest.fixture(params=["7b", "40b", "128m"])
def block_bytes(spark, request):
    """Files in many blocks, in a few, or in one."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield request.param
    spark.conf.set(key, before)


def test_run_logs_split_like_python(spark, tmp_path, block_bytes):
    text = "one\r\ntwo\x0bthree\n\nfour five\x85six\x1cseven\neight\n"
    (tmp_path / "run-1.log").write_bytes(text.encode() + b"bad \xff byte\n")
    (tmp_path / "run-2.log").write_text("a\nb")
    rows = runlogs.read_run_logs(spark, str(tmp_path))
    first = [r["line"] for r in rows.where("run_id = 'run-1'").orderBy("line_no").collect()]
    assert first == [*text.splitlines(), "bad � byte"]
    assert got(rows.where("run_id = 'run-2'"), "line_no", "line") == [(0, "a"), (1, "b")]


def test_ends_and_blocks_of_run_logs(spark, tmp_path, block_bytes):
    """Every kind of last line, and breaks of two bytes across the edges of blocks."""
    bodies = ["", "\n", "a", "\n\n"]
    ends = ["", "\n", "\r", "\r\n", "\r\r", "\x0b", "\x0b\n", "\x0b\r\n", "\u2028", "x\x0b\x0b", "\n\x0b", "\n\r"]
    texts = [b + e for b in bodies for e in ends]
    texts += ["".join(f"line {i}" + "x" * (i % 5) + "\r\n" for i in range(60)), "é\u2029ü" * 40 + "\r\n" + "ö\n"]
    wanted = []
    for n, text in enumerate(texts):
        (tmp_path / f"r{n}.log").write_bytes(text.encode())
        wanted += [(f"r{n}", i, line) for i, line in enumerate(text.splitlines())]
    rows = runlogs.read_run_logs(spark, str(tmp_path))
    assert got(rows, "run_id", "line_no", "line") == sorted(wanted, key=repr)


def test_run_logs_of_one_name_in_two_folders_are_numbered_apart(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "run.log").write_text("x\ny\n")
    rows = runlogs.read_run_logs(spark, str(tmp_path / "*"))
    assert got(rows, "line_no", "line") == [(0, "x"), (0, "x"), (1, "y"), (1, "y")]


def test_media_routes(spark, tmp_path):
    (tmp_path / "7.png").write_bytes(b"abc")
    row = media.read_media(spark, str(tmp_path), "*.png").first()
    assert (row["name"], row["length"], bytes(row["content"])) == ("7", 3, b"abc")
    files = table(spark, "file_id bigint, mime string", (1, " VIDEO/mp4 "), (2, "image/png"), (3, None), (4, "image/gif"))
    full = table(spark, "file_id bigint, content binary", (1, b"never"), (2, b"full"), (3, None))
    thumbs = table(spark, "file_id bigint, content binary", (1, b"t1"), (2, b"t2"), (3, b"t3"))
    rows = media.pick_raster(media.route_media(files), full, thumbs)
    assert [(r[0], bytes(r[1])) for r in got(rows, "file_id", "content")] == [(1, b"t1"), (2, b"full"), (3, b"t3")]


def test_listing_does_not_read_contents(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "model.onnx").write_bytes(b"x" * 10)
    listing = labels.read_listing(spark, str(tmp_path))
    assert got(listing) == [("m", "model.onnx", 10)]
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_no_rows_at_all(spark):
    none = spark.createDataFrame([], "pos bigint, file_id bigint")
    assert B.neighbours(none).count() == 0 and B.run_order(none).count() == 0
    assert B.run_order(none).agg(F.count("*")).first()[0] == 0


def test_a_label_table_is_one_file(spark, tmp_path):
    from tagspark.sources.labels import read_labels

    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("tag_id,name,category,count\n1,x,0,1\n")
    assert read_labels(spark, str(tmp_path / "a.csv")).count() == 1
    with pytest.raises(ValueError, match="several"):
        read_labels(spark, str(tmp_path))

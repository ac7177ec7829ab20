"""Scalar and array functions: golden values."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tagspark.functions import loglines as L
from tagspark.functions import numbers as N
from tagspark.functions import taglists as T
from tagspark.functions import text as X


@pytest.mark.parametrize(
    "raw",
    ["Blue_Hair", "  rating:general ", "wd14:Foo-Bar", "_", "\xa0x\xa0", "\x1cx\x1f", "　Ä b ", "-a_", ""],
)
def test_normalize_tag_equals_plain_python(one, raw):
    wanted = raw.replace("_", " ").replace("-", " ").strip().lower()
    assert one(X.normalize_tag("t"), t=raw) == wanted
    assert X.normalize_text(raw) == wanted


def test_every_white_space_character_is_stripped(one):
    python = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    assert set(X.WHITESPACE) == set(python)
    assert one(X.strip("t"), t=python + "a b" + python) == "a b"


@pytest.mark.parametrize(
    "name, template, marker",
    [
        ("", "", ""),
        (None, None, ""),
        (" m ", "", "wd14:m"),
        ("m", "tagged:{model_name}!", "tagged:m!"),
        ("m", "literal", "literal"),
        ("m", "{model_name} {other}", "wd14:m"),
        ("m", "{model_name} {", "wd14:m"),
    ],
)
def test_model_marker(name, template, marker):
    assert X.model_marker(name, template) == marker


def test_model_tier_and_slug(one):
    assert one(X.model_tier("t"), t=" wd_vit_tagger-v3 ") == 1
    assert one(X.model_tier("t"), t="WD-vit-tagger-v3") == 0
    assert one(X.model_tier("t"), t="custom") == 0
    assert one(X.marker_slug("t"), t="  WD14: wd-EVA02 ") == "wd-EVA02"
    assert one(X.marker_slug("t", "my_run"), t="My_Run:x") == "x"
    assert one(X.marker_slug("t"), t="wd14:  ") is None
    assert one(X.marker_slug("t"), t="xwd14:a") is None
    assert one(X.may_be_marker("t"), t="wd14:a") is True
    assert one(X.may_be_marker("t", "_p"), t=X.normalize_text("_P:x")) is True


def test_terms_and_service_labels(one):
    assert one(X.split_terms("t"), t=" a, b ,,  c d ,") == ["a", "b", "c d"]
    assert one(X.service_label(F.lit(None).cast("string"), "k"), k="0123456789") == "01234567..."
    assert one(X.service_label("n", "k"), n="mine", k="0123456789") == "mine"


@pytest.mark.parametrize(
    "tags, canonical, wanted, removed",
    [
        (["x", "wd14:model-b", "y", "wd14:legacy-z"], "wd14:model-a", ["x", "y", "wd14:model-a"], 2),
        (["wd14:my_model", "wd14:my-model", "z"], "wd14:my-model", ["wd14:my-model", "z"], 1),
        (["a", " ", "WD14:M"], " wd14:m ", ["a", "wd14:m"], 0),
        ([], "wd14:m", ["wd14:m"], 0),
        (["a", " ", "wd14:b"], "", ["a", " ", "wd14:b"], 0),
        (["a", "wd14:b"], "other:m", ["a", "wd14:b"], 0),
    ],
)
def test_dedupe_markers(spark, tags, canonical, wanted, removed):
    df = spark.createDataFrame([(tags,)], "tags array<string>")
    row = df.select(T.dedupe_markers("tags", canonical).alias("r")).first()["r"]
    assert (row["tags"], row["removed"]) == (wanted, removed)


def test_contains_tag(spark):
    df = spark.createDataFrame([(["Blue-Hair", None],)], "tags array<string>")
    hit = df.select(
        T.contains_tag("tags", " blue_hair ").alias("a"), T.contains_tag("tags", "x").alias("b"), T.contains_tag("tags", " ").alias("c")
    ).first()
    assert tuple(hit) == (True, False, False)


def test_format_and_result_tags(spark):
    kind = "array<struct<tag:string,conf:double>>"
    df = spark.createDataFrame(
        [([("long_hair", 0.9)], [("a_b", 0.8)], [("safe_ish", 0.7), ("other", 0.1)], [], ["f"])],
        f"g {kind}, c {kind}, r {kind}, tags array<string>, formatted array<string>",
    )
    row = df.select(
        T.format_tags("g", "c", "r").alias("flat"),
        T.format_tags("g", "c", "r", "g:", "", "").alias("bare"),
        T.result_tags("tags", "formatted", "g", "c", "r").alias("res"),
        T.result_tags("tags", "tags", "g", "c", "r").alias("rebuilt"),
    ).first()
    assert row["flat"] == ["long hair", "character:a b", "rating:safe_ish"]
    assert row["bare"] == ["g:long hair", "a b", "safe_ish"]
    assert row["res"] == ["f"]
    assert row["rebuilt"] == row["flat"]


def test_merge_suggestions_keeps_order_and_exact_text(spark):
    df = spark.createDataFrame([(["a", "B"], ["c", "a", "b", "c", "d"])], "d array<string>, p array<string>")
    assert df.select(T.merge_suggestions("d", "p")).first()[0] == ["c", "b", "d"]


@pytest.mark.parametrize("raw, wanted", [(None, 32), ("x", 32), (0, 1), (500, 128), ("7", 7), ("7.0", 32)])
def test_clamp_window(one, raw, wanted):
    assert one(N.clamp_setting(F.lit(raw), "tuning_window")) == wanted


@pytest.mark.parametrize("raw, wanted", [(None, 0.1), ("x", 0.1), (0.0, 0.01), (0.9, 0.5), ("0.25", 0.25), (math.nan, 0.5)])
def test_clamp_fraction(one, raw, wanted):
    assert one(N.clamp_fraction(F.lit(raw))) == wanted
    assert N.fraction_of(raw) == wanted


@pytest.mark.parametrize("raw, wanted", [(None, None), ("x", None), (0, None), (-3, None), (1, 30.0), (9999, 3600.0), ("45", 45.0)])
def test_clamp_timeout(one, raw, wanted):
    assert one(N.clamp_timeout(F.lit(raw))) == wanted


@pytest.mark.parametrize("lo, hi, wanted", [(1, 9, [1, 5, 9]), (9, 1, [1, 5, 9]), (4, 4, [4]), (1, 2, [1, 2])])
def test_triplet(one, lo, hi, wanted):
    assert one(N.triplet("a", "b"), a=lo, b=hi) == wanted


@pytest.mark.parametrize(
    "outcome, stopped, status",
    [("ok", False, "complete"), ("ok", True, "stopped"), ("error", True, "error"), ("empty_queue", True, "skipped")],
)
def test_outcome_status(one, outcome, stopped, status):
    assert one(N.outcome_status("o", "s"), o=outcome, s=stopped) == status


def test_rates_and_progress_bar(one):
    assert one(N.throughput("e", "f", "t"), e=0.3, f=3, t=4)["files_per_s"] is None
    assert one(N.throughput("e", "f", "t"), e=2.0, f=3, t=4)["files_per_s"] == 1.5
    bar = lambda **k: tuple(one(N.progress_bar("i", "n", "d", "t"), **k))
    assert bar(i=0, n=0, d=5, t=9) == (5, 9)
    assert bar(i=6, n=4, d=5, t=9) == (4, 6)
    assert bar(i=6, n=6, d=8, t=9) == (2, 3)
    assert bar(i=9, n=9, d=9, t=9) == (0, 1)


def test_zero_counts_as_missing(one):
    assert one(N.batch_files("a", "b"), a=0, b=4) == 4
    assert one(N.batch_files("a", "b"), a=3, b=4) == 3
    assert one(N.batch_files("a", "b"), a=0, b=0) == 0


def test_log_fields(one):
    line = "2026-03-31 13:38:44 INFO [rid] [a.b] hello [x] y"
    f = one(L.log_fields("l"), l=line)
    assert (str(f["ts"]), f["level"], f["run_id"], f["logger"], f["message"]) == (
        "2026-03-31 13:38:44", "INFO", "rid", "a.b", "hello [x] y",
    )
    assert one(L.log_fields("l"), l="no prefix")["ts"] is None


def test_metrics_record_leaves_missing_fields_null(one):
    r = one(L.metrics_record("l"), l="x wall_onnx_predict_s=1.250 inferred_files=3 y")
    assert (float(r["predict_s"]), r["fetch_s"], r["skipped_files"], r["inferred_files"]) == (1.25, None, None, 3)


def test_fields_are_read_by_name_whatever_their_order(one):
    line = "x model=m/1 outcome=ok/complete tag_strings=4; hydrus_files=3, outer_batches=2 processed=9 model_prepare_s=0.5 wall_s=1.25 wall_s=9"
    r = one(L.record("l", L.PERF), l=line)
    assert (float(r["wall_s"]), r["processed"], r["written_files"], r["tag_strings"], r["outcome"], r["status"], r["model"]) == (
        1.25, 9, 3, 4, "ok", "complete", "m/1",
    )
    for broken in (line.replace("processed=9", "processed=nine"), line.replace("ok/complete", "ok"), line.replace("model=m/1", "model="), "", None):
        assert one(L.record("l", L.PERF), l=broken) is None
    assert one(L.config_record("l"), l="ort_cpu_threads_intra_inter=6/2 config_inference_batch_saved=8") is None
    assert one(L.read_fields("l", L.QUEUE), l="infer skip_same_marker= missing_metadata==5 skip_higher_tier=7")["skip_higher"] == 7


def test_stats_line_round_trip(spark):
    df = spark.createDataFrame(
        [("a b", True, 1.5, float("nan"), None, "it's", 'q"', "p\n=")],
        "s string, f boolean, r double, n double, z string, a string, q string, e string",
    )
    values = {
        "z_last": L.stats_value("s", "text"),
        "a_first": L.stats_value("f", "flag"),
        "m_mid": L.stats_value("r", "real"),
        "nan": L.stats_value("n", "real"),
        "none": L.stats_value("z", "text"),
        "apos": L.stats_value("a", "text"),
        "quote": L.stats_value("q", "text"),
        "eq": L.stats_value("e", "text"),
        "int": L.stats_value(F.lit(7), "integer"),
        "ten": L.stats_value(F.lit(10.0), "real"),
        "zero": L.stats_value(F.lit(0.0), "real"),
    }
    lines = df.select(L.stats_line(F.lit("unit_op"), values).alias("line"))
    line = lines.first()["line"]
    plain = {
        "a_first": "true", "apos": "it's", "eq": repr("p ="), "int": "7", "m_mid": "1.5", "nan": "nan",
        "none": "", "quote": repr('q"'), "ten": "10", "z_last": repr("a b"), "zero": "0",
    }
    assert line == "stats op=unit_op " + " ".join(f"{k}={v}" for k, v in sorted(plain.items()))
    parsed = lines.select(L.parse_stats_line("line").alias("m")).first()["m"]
    assert parsed["op"] == "unit_op" and parsed["z_last"] == "a b" and parsed["eq"] == "p =" and parsed["quote"] == 'q"'
    assert lines.select(L.parse_stats_line(F.lit("other"))).first()[0] is None

"""The pipeline stage by stage against brute force, and its end as a whole."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline as C
import pytest
from conftest import got
from pyspark.sql import functions as F

from tagspark.session import cut_lineage

from .conftest import words
from .test_exact_and_near import brute_copies, brute_near, plain
from .test_rules_and_mix import brute_measures

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, words(i, 60), "en", f"src{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, words(i, 60).replace(" ", "  "), "en", "src0", 1) for i in range(5)]  # longer copies
    rows += [(200 + i, words(500, 400) + f" end{i}", "de", None, None) for i in range(30)]  # near copies
    rows += [(300, None, None, None, None), (None, "too few words", "en", "src1", 3), (301, "a " * 50, "en", "src1", 3)]
    rows += [(400, words(77, 50), None, "src2", 1)] * 3 + [(None, words(78, 50), "fr", "src2", 1)] * 2
    return cut_lineage(spark.createDataFrame(rows, COLUMNS).repartition(4), "pipeline-test")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def rejected(text):
    n_words, chars, symbols, lines, repeated, again = brute_measures(text)
    return (
        n_words < 10 or 100 * again > 20 * n_words or 10 * symbols > n_words or 100 * repeated > 30 * lines
        or chars < 2 * n_words or chars > 20 * n_words
    )


def test_stages(spark, docs):
    folder = "unused"
    ruled = cut_lineage(C.reject_by_rules(spark, docs, folder), "ruled")
    assert ruled.columns == docs.columns
    assert got(ruled, "doc_id", "text") == sorted(((d, t) for d, t in texts(docs) if not rejected(t)), key=repr)

    unique = cut_lineage(C.drop_exact_copies(spark, ruled, folder), "unique")
    assert unique.columns == docs.columns
    kept = brute_copies(texts(ruled))
    assert Counter(got(unique, "doc_id")) == Counter({(k,): 1 for k in {keep for _, keep, _, _ in kept if keep is not None}} | {(None,): 1})
    assert len({plain(t) for _, t in texts(unique)}) == unique.count()
    assert unique.where("doc_id < 5").count() == 0 and unique.where("doc_id between 100 and 104").count() == 5

    apart = cut_lineage(C.drop_near_copies(spark, unique, folder), "apart")
    components = {c for _, _, c in brute_near(texts(unique))}
    assert {d for d, _ in texts(apart)} == components and apart.count() == len(components)
    assert apart.where("doc_id >= 200 and doc_id < 300").count() < 30

    mixed = cut_lineage(C.mix_sources(spark, apart, folder), "mixed")
    assert mixed.columns == docs.columns
    times = Counter(texts(mixed))
    assert set(times) <= set(texts(apart)) and max(times.values()) <= 2
    size = lambda rows: sum(len(t.split()) for _, t in rows)
    assert abs(size(texts(mixed)) - 1.5 * size(texts(apart))) <= 400

    pieces = C.pack(spark, mixed, folder).collect()
    by = defaultdict(int)
    for p in pieces:
        by[p["doc_id"]] += p["length"]
    per_doc = {p["doc_id"]: p["doc_tokens"] for p in pieces if p["doc_id"] is not None}
    docs_times = Counter(d for d, _ in texts(mixed))
    assert all(by[d] == per_doc[d] * docs_times[d] for d in per_doc)


def test_run_is_the_stages_one_after_the_other(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, folder), name)
    whole = C.run(spark, folder)
    assert whole.select(F.sum("length"), F.count("*") > 0).first() == C.pack(spark, docs, folder).select(F.sum("length"), F.count("*") > 0).first()
    assert [name for name, _ in C.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mix_sources", "packing"]


def test_an_empty_table_goes_through(spark, docs):
    empty = docs.limit(0)
    for _, stage in C.STAGES[:-1]:
        empty = cut_lineage(stage(spark, empty, "unused"), "empty")
        assert empty.count() == 0
    assert C.pack(spark, empty, "unused").count() == 0


def test_rows_are_found_again_when_files_are_split_otherwise(spark):
    stored = cut_lineage(spark.range(4_000).select(
        F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.lit("en").alias("lang"),
        F.lit("s").alias("source"), F.lit(64).cast("bigint").alias("n_chars"),
    ).repartition(3), "split-test")
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)

    def decide(files):
        decided = cut_lineage(files.select(C.ROW, "file_id", F.col("file_id").alias("decided")), "decided")
        spark.conf.set(setting, "10000")
        return decided

    try:
        found = C._decided(stored, decide)
        assert found.count() == 4_000 and found.where("doc_id = decided").count() == 4_000
    finally:
        spark.conf.set(setting, before)

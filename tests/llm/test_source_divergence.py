"""Divergence of services against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from conftest import got
from pyspark.sql import functions as F

from tagspark.llm import source_divergence as S
from tagspark.llm.texts import tag_texts

SCHEMA = "file_id bigint, mime string, service_key string, tag_text string, term string, n int, item string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "t", 5, "i", "r") for i, r in enumerate(rows)], SCHEMA)


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))


def brute(rows, min_files=3, top=200):
    rows = [tuple(v or "" for v in r) for r in rows]
    holding, counts, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for mime, key, text in rows:
        found = terms(text)
        holding[mime].update(set(found))
        counts[mime, key].update(found)
        whole[mime].update(found)
    out = []
    for mime in {m for m, _ in counts}:
        kept = [t for t, n in holding[mime].items() if n >= min_files]

        def shares(counter):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 1) // (total + len(kept)) for t in kept}

        keys = [k for m, k in counts if m == mime]
        of = {k: shares(counts[mime, k]) for k in keys}
        q = shares(whole[mime])
        for k in keys:
            pairs = [(o, sum((of[k][t] - of[o][t]) ** 2 // of[o][t] for t in kept)) for o in keys if o != k]
            own = [(t, (of[k][t] - q[t]) ** 2 // q[t]) for t in kept if counts[mime, k][t] and of[k][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", own, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(mime, k, part, item, v, r) for r, (item, v) in enumerate(found[:most], 1)]
    return sorted(out, key=repr)


COLUMNS = ("mime", "service_key", "part", "item", "value", "rank")


def cases(seed, n=300):
    draw = random.Random(seed)
    vocabulary = ["Hair,", "hair", "EYES/blue", "x1y", "naïve", "ÉTÉ", "été", "日本", "a_b", "123", "...", "don't", " ", "ſ"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows = []
    for _ in range(n):
        mime = draw.choice(["image/png", "image/jpeg", None])
        key = draw.choice(["svc1", "svc2", "svc3", None]) if draw.random() < 0.6 else "svc1"
        text = "".join(draw.choice(vocabulary[: draw.choice([14, 60, 214])]) + draw.choice(" \n\t\x0b  ") for _ in range(draw.choice([0, 1, 5, 40])))
        rows.append((mime, key, draw.choice([text, text, text, None])))
    return rows + [("image/png", "svc9", "only once"), ("video/mp4", "svc1", "nothing kept"), ("video/mp4", "svc2", None)]


def test_divergence_equals_brute_force(spark, monkeypatch):
    rows = cases(1)
    assert got(S.source_divergence(table(spark, rows)), *COLUMNS) == brute(rows)


def test_other_bounds_and_repeated_rows(spark):
    rows = cases(2, 80) * 2
    assert got(S.source_divergence(table(spark, rows), min_files=1, top=3), *COLUMNS) == brute(rows, 1, 3)


def test_pair_sums_go_on_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = cases(3, 120)
        assert got(S.source_divergence(table(spark, rows), 2), *COLUMNS) == brute(rows, 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shares_are_exact_for_huge_counts(spark):
    n, total, vocabulary = 9 * 10**17 + 7, 9 * 10**18, 12345
    row = spark.range(1).select(S.share_of(F.lit(n), F.lit(total), F.lit(vocabulary)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 1) // (total + vocabulary)


def test_long_texts_empty_tables_and_tag_texts(spark):
    rows = [("m", k, " ".join(f"Tag{chr(97 + j % 7)}" for j in range(j0, 60_000))) for j0, k in enumerate(("a", "b", "b", "c"))]
    assert got(S.source_divergence(table(spark, rows)), *COLUMNS) == brute(rows)
    assert S.source_divergence(table(spark, rows).limit(0)).collect() == []
    tags = spark.createDataFrame(
        [(f, f"svc{f % 2}", p, t) for f in range(6) for p, t in enumerate(["blue hair", f"tag {'xy'[f % 2]}"])],
        "file_id bigint, service_key string, pos bigint, tag string",
    )
    texts = tag_texts(tags).withColumn("mime", F.lit("image/png"))
    assert got(S.source_divergence(texts), *COLUMNS) == brute([("image/png", f"svc{f % 2}", f"blue hair\ntag {'xy'[f % 2]}") for f in range(6)])

"""The prefix trie against brute force, with hot sequences, long sessions and odd rows."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import got
from pyspark.sql import functions as F

from tagspark.llm import prefix_trie as T
from tagspark.plans.library import Library

SCHEMA = "session_id bigint, seq bigint, type string, text string, n int, place string, id string, band int"
COLUMNS = ("session_id", "depth", "parent_session_id", "n_sessions", "n_children", "n_leaves", "saved_words", "ends_sha256")


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "i", 2) for r in rows], SCHEMA)


def brute(rows, more=()):
    listed = defaultdict(list)
    for session, seq, kind, text in rows:
        if session is not None:
            kind, text = kind or "", text or ""
            name = hashlib.sha256(f"{len(kind)}:{kind}{text}".encode()).digest()[: T.NAME_BYTES]
            listed[session].append((seq is not None, seq or 0, name, (kind, text)))
    sequences = {s: tuple(e[3] for e in sorted(listed[s])) for s in {*listed, *more}}
    members = defaultdict(list)
    for s, found in sequences.items():
        for d in range(len(found) + 1):
            members[found[:d]].append(s)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1].split()) if p else 0
    out = []
    for p, own in members.items():
        ends = ",".join(map(str, sorted(s for s in own if len(sequences[s]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(own), len(p), parent, len(own), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def cases(seed, n=120):
    draw = random.Random(seed)
    texts = ["a", "b c", "", None, "a b", "d\ne f"]
    rows = []
    for s in range(n):
        length = draw.choice([0, 1, 2, 3, 5, 9])
        common = draw.choice([0, 0, 2, 5])
        for k in range(length):
            kind, text = ("user", texts[k % 2]) if k < common else (draw.choice(["user", "assistant", None]), draw.choice(texts))
            rows.append((s * 3 % 101 if s < 10 else s, draw.choice([k, k, k, None]), kind, text))
    rows += [(1000 + k, j, "t", f"step {j}") for k in range(40) for j in range(7)]  # one hot sequence
    rows += [(2000, j, "t", f"step {j}") for j in range(60)] + [(2001, j, "t", f"step {j}") for j in range(55)]
    rows += [(None, 1, "t", "x"), (5, 0, "t", "x"), (5, 0, "t", "x"), (-7, 1, "t", "y")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("band_events, batch", [(512, 10_000), (512, 9), (1, 50), (2, 7), (3, 10_000), (7, 5)])
def test_trie_equals_brute_force(spark, band_events, batch):
    rows = cases(band_events)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = T.prefix_trie(table(spark, rows), band_events=band_events)
        assert got(found, *COLUMNS) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sessions_without_events_and_no_sessions(spark):
    rows = [(3, 1, "user", "hi"), (8, 1, "user", "hi")]
    more = table(spark, [(9, None, None, None), (1, None, None, None), (None, None, None, None), (3, None, None, None)]).select("session_id", "n")
    assert got(T.prefix_trie(table(spark, rows), more), *COLUMNS) == brute(rows, (9, 1))
    assert got(T.prefix_trie(table(spark, rows).limit(0), more), *COLUMNS) == brute([], (9, 1, 3))
    assert T.prefix_trie(table(spark, rows).limit(0)).collect() == []


def test_ids_are_digested_across_rows_and_batches(spark, monkeypatch):
    ids = list(range(-5, 3000))
    bands = table(spark, [(i, 0, "t", "same") for i in ids])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        found = T.prefix_trie(bands).where("depth = 1").first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found["n_ends"] == len(ids) and found["ends_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_extents_and_least_values_equal_a_scan():
    draw = random.Random(6)
    for n in (1, 2, 3, 17, 64):
        common = np.array([draw.randrange(4) for _ in range(n - 1)], np.int64)
        at = np.repeat(np.arange(n), 4)
        depth = np.tile(np.arange(1, 5), n)
        left, right = T.extents(common, at, depth)
        for i, d, x, y in zip(at, depth, left, right, strict=True):
            low = high = i
            while low and common[low - 1] >= d:
                low -= 1
            while high < n - 1 and common[high] >= d:
                high += 1
            assert (x, y) == (low, high)


def test_session_events_of_the_library(spark):
    events = Library(spark, "/root/testdata/sf0.001").session_events.withColumn("text", F.col("k").cast("string"))
    rows = [(r["session_id"], r["seq"], r["type"], r["text"]) for r in events.collect()]
    assert got(T.prefix_trie(events, band_events=16), *COLUMNS) == brute(rows)

"""Block naming, SimHash, components: against brute force, with copies, chains and hot groups."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
import xxhash
from conftest import got
from pyspark.sql import functions as F

from tagspark.llm import block_names, simhash
from tagspark.llm.components import components

from .conftest import files, words


def plain(text):
    return b"".join((text or "").encode().split())


def brute_copies(rows):
    groups = defaultdict(list)
    for place, (file_id, text) in enumerate(rows):
        groups[plain(text)].append((-len(text or ""), file_id is None, file_id or 0, place))
    out = []
    for same, members in groups.items():
        best = min(members)
        digest = hashlib.sha256(same).hexdigest()
        keep = None if best[1] else best[2]
        for _, no_id, file_id, _ in members:
            out.append((None if no_id else file_id, keep, len(members), digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, memory", [(1, 10), (3, 64), (16, 1 << 20), (2_048, 1 << 20)])
def test_copies_equal_brute_force(spark, block, memory):
    draw = random.Random(block)
    texts = ["".join(draw.choice("ab \n") for _ in range(draw.randrange(40))) for _ in range(60)] + ["aabb" * 9] * 20
    rows = [(i, draw.choice(texts)) for i in range(150)] + [(None, "ab"), (7, None)]
    df = files(spark, *[(i, t, None) for i, t in rows]).repartition(3)
    found = block_names.duplicate_files(df, block, memory)
    assert got(found, "file_id", "keep_id", "group_size", "text_sha256") == brute_copies(rows)
    assert found.where("kept").count() == len({plain(t) for _, t in rows})
    assert found.groupBy("text_sha256").agg(F.countDistinct("level", "identity").alias("n")).where("n > 1").count() == 0


def test_copies_of_odd_rows(spark, odd_files, no_files):
    rows = [(r["file_id"], r["tag_text"]) for r in odd_files.collect()]
    found = block_names.duplicate_files(odd_files)
    assert got(found, "file_id", "keep_id", "group_size", "text_sha256") == brute_copies(rows)
    assert block_names.duplicate_files(no_files).collect() == []


def test_the_longest_copy_with_the_smallest_id_stays(spark):
    df = files(spark, (9, "ab", None), (3, "a b", None), (2, "a b", None), (1, "ab", None))
    assert got(block_names.duplicate_files(df), "file_id", "keep_id", "kept") == [(1, 2, False), (2, 2, True), (3, 2, False), (9, 2, False)]
    handed = block_names.duplicate_files(df.withColumn("pos", F.col("file_id") * 10), key="pos")
    assert got(handed, "file_id", "pos") == [(1, 10), (2, 20), (3, 30), (9, 90)]


def brute_fingerprint(text):
    found = (text or "").encode().lower().split()
    shingles = [b" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))] if found else []
    digests = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(d >> b & 1 for d in digests) > len(digests))


def brute_near(rows, most=4):
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (file_id, _) in enumerate(rows):
        if file_id is not None:
            least[root(i)].append(file_id)
    return sorted(
        ((f, f"{prints[i]:016x}", min(least[root(i)], default=None)) for i, (f, _) in enumerate(rows)), key=repr
    )


@pytest.mark.parametrize("node_rows", [2, 16_384])
def test_near_copies_equal_brute_force(spark, node_rows):
    draw = random.Random(3)
    texts = []
    for k in range(40):
        base = words(k, draw.choice([3, 40, 300])).split(" ")
        for _ in range(draw.choice([1, 3, 8])):
            some = list(base)
            for _ in range(draw.randrange(3)):
                some[draw.randrange(len(some))] = "changed"
            texts.append(" ".join(some))
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(1500 + i, "one TWO") for i in range(80)]
    df = files(spark, *[(i, t, None) for i, t in rows])
    found = simhash.near_duplicates(df, node_rows=node_rows)
    assert got(found, "file_id", "fingerprint", "component_id") == brute_near(rows)
    assert found.where("kept and file_id <> component_id").count() == 0
    assert found.where("kept").count() == found.select("component_id").distinct().count()


def test_near_copies_of_odd_rows(spark, odd_files, no_files):
    rows = [(r["file_id"], r["tag_text"]) for r in odd_files.collect()]
    assert got(simhash.near_duplicates(odd_files), "file_id", "fingerprint", "component_id") == brute_near(rows)
    assert simhash.near_duplicates(no_files).collect() == []


@pytest.mark.parametrize("node_rows", [40, 100_000])
def test_links_connect_all_near_fingerprints(spark, node_rows):
    draw = random.Random(8)
    values = {draw.getrandbits(64) for _ in range(300)}
    chain = draw.getrandbits(64)
    for bit in range(40):  # a chain whose ends are far apart
        chain ^= 1 << bit
        values.add(chain)
    dense = draw.getrandbits(64)  # many fingerprints within a few bits of one
    values |= {dense ^ 1 << a ^ 1 << b for a in range(24) for b in range(24)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.links(spark.createDataFrame(signed, "fingerprint bigint"), node_rows=node_rows)
    found = dict(got(components(links), "node", "root"))
    order = sorted(v for (v,) in signed)
    parent = {v: v for v in order}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(order):
        for b in order[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {v: found.get(v, v) for v in order} == {v: root(v) for v in order}


def test_components_of_chains_stars_and_nothing(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 2000 + i) for i in range(100)] + [(5, 5), (None, 3), (300, 299), (299, 300)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    found = dict(got(components(df), "node", "root"))
    assert found == {i: 0 for i in range(61)} | {1000: 1000} | {2000 + i: 1000 for i in range(100)} | {299: 299, 300: 299}
    assert components(df.limit(0)).collect() == []

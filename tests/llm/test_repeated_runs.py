"""Repeated byte runs against brute force, with hot runs, colliding hashes and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from conftest import got
from pyspark.sql import functions as F

from tagspark.llm import repeated_runs as R
from tagspark.llm.texts import tag_texts

from .conftest import files, words


def brute(rows, length):
    """(file_id, spans, kept) of (file_id, text) rows."""
    rank = [float("inf") if i is None else i for i, _ in rows]
    texts = [(t or "").encode() for _, t in rows]
    least = {}
    for r, t in zip(rank, texts, strict=True):
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            least[s] = min(least.get(s, r), r)
    out = []
    for (file_id, _), r, t in zip(rows, rank, texts, strict=True):
        gone = set()
        for k in range(len(t) - length + 1):
            if least[t[k : k + length]] < r:
                gone |= set(range(k, k + length))
        spans = [k for k in sorted(gone) if k - 1 not in gone], [k + 1 for k in sorted(gone) if k + 1 not in gone]
        kept = bytes(b for k, b in enumerate(t) if k not in gone)
        out.append((file_id, len(t), [(a, b - a) for a, b in zip(*spans, strict=True)], kept))
    return sorted(out, key=repr)


def found(df, length=50, **more):
    rows = R.repeated_runs(df, length, **more).collect()
    return sorted(((r["file_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in rows), key=repr)


def cases(seed):
    draw = random.Random(seed)
    line = "a line that very many of the files hold, word for word, "
    texts = [words(k, draw.choice([0, 3, 20, 60]), 30) for k in range(25)]
    for k in range(60):
        cut = draw.randrange(len(line))
        texts.append(words(100 + k, 8) + line * draw.choice([1, 1, 2]) + words(k % 9, 12, 30) + line[cut:] + draw.choice(texts[:25])[cut:])
    texts += ["ab" * 100, "ab" * 60, "a" * 300, "a" * 49, "é" * 80, "xé" + "é" * 90, "", None]
    rows = [(draw.randrange(60), t) for t in texts] + [(None, texts[3]), (None, texts[3]), (7, texts[30]), (7, texts[30])]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("length, hot", [(50, 256), (50, 1), (6, 256), (17, 2), (3, 0)])
def test_runs_equal_brute_force(spark, length, hot):
    rows = cases(length)
    df = files(spark, *[(i, t, None) for i, t in rows]).repartition(3)
    assert found(df, length, hot_blocks=hot) == brute(rows, length)


@pytest.mark.parametrize("length, hot", [(50, 0), (50, 4), (50, 40), (17, 3), (3, 20)])
def test_runs_of_grams_with_many_pieces_equal_brute_force(spark, length, hot):
    rows = cases(length + hot)
    df = files(spark, *[(i, t, None) for i, t in rows]).repartition(3)
    assert found(df, length, hot_pieces=hot) == brute(rows, length)


def blocks_of(texts, blocks):
    """The tables of the blocks that texts are dealt into."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["file_id", "tag_text"])
    dealt = pa.Table.from_batches(R._pack_texts(iter([batch]), blocks))
    return [dealt.slice(k, 1) for k in range(dealt.num_rows)]


def test_a_gram_of_many_blocks_but_few_pieces_is_not_cut_into_runs():
    """A line in 400 blocks: its pieces are sent whole, not once for each of their runs; by pieces it is cut."""
    line = " a line that very many of the blocks hold, word for word, once each, and no more often than that"
    blocks = blocks_of([words(k, 9, 10_000) + line + words(k + 2_000, 9, 10_000) for k in range(1_500)], 400)
    assert len(blocks) > 380
    keys = pa.concat_tables([R._send_keys(t, 50, 1) for t in blocks])
    sizes = {}
    for most in (R.HOT_PIECES, 300):
        marks = pa.Table.from_batches(R._mark_keys(iter(keys.to_batches()), None, most))
        own = [m for m in range(marks.num_rows) if marks["block"][m].as_py() == blocks[0]["block"][0].as_py()]
        sent = R._send_pieces(blocks[0], marks.take(own), 50, 1)
        rows = [d for b, d in zip(sent["bucket"].to_pylist(), sent["pieces"].to_pylist(), strict=True) if b != R.KNOWN]
        sizes[most] = np.concatenate([R._unpacked(d, "u8", "u2", "u2", "u4", "i4", "i8", "u1")[1] for d in rows])
    assert sizes[R.HOT_PIECES].max() > 50 and sizes[300].sum() > 3 * sizes[R.HOT_PIECES].sum()


def test_spans_of_a_block_are_sent_once_whatever_the_shares(monkeypatch):
    blocks = blocks_of([words(k % 40, 30) for k in range(120)], 7)
    keys = pa.concat_tables([R._send_keys(t, 50, 1) for t in blocks])
    marks = pa.Table.from_batches(R._mark_keys(iter(keys.to_batches()), None, R.HOT_PIECES))
    pieces = []
    for t in blocks:
        own = [m for m in range(marks.num_rows) if marks["block"][m] == t["block"][0]]
        pieces.append(R._send_pieces(t, marks.take(own), 50, 1))
    spans = {}
    for size, at_once in ((1 << 23, 1_000), (500, 1_000), (500, 2)):
        monkeypatch.setattr(R, "SORT_BYTES", size)
        monkeypatch.setattr(R, "SPAN_ROWS", at_once)
        rest = pa.concat_tables(pieces).filter(pc.not_equal(pa.concat_tables(pieces)["bucket"], R.KNOWN))
        rows = pa.Table.from_batches(R._find_runs(iter(rest.combine_chunks().to_batches()), 50)).to_pylist()
        assert len({r["block"] for r in rows}) == len(rows) > 3
        spans[size, at_once] = {r["block"]: sorted(zip(*(c.tolist() for c in R._unpacked(r["spans"], "i8", "i8", "i8")), strict=True)) for r in rows}
    one, *others = spans.values()
    assert all(o == one for o in others)


def test_long_texts_lie_in_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 130)
    texts = [(t or "").encode() for _, t in cases(1)]
    whole = {(p[0], p[1]) for p in pieces(texts, 50)}
    monkeypatch.setattr(R, "CHUNK", 1 << 20)
    assert whole == {(p[0], p[1]) for p in pieces(texts, 50)}


def pieces(texts, length):
    """Each run's document and place, with what names it."""
    out = set()
    for chunk in R.chunks_of(texts, length):
        for doc, start, size, key in zip(chunk.doc, chunk.start, chunk.size, chunk.key, strict=True):
            out |= {((int(doc), int(start) + k), int(key)) for k in range(int(size) - length + 1)}
    return out


def test_every_run_has_one_gram_and_equal_runs_the_same():
    texts = [(t or "").encode() for _, t in cases(2)]
    named = {}
    count = 0
    for (doc, start), key in pieces(texts, 50):
        assert named.setdefault(texts[doc][start : start + 50], key) == key
        count += 1
    assert count == sum(max(0, len(t) - 49) for t in texts)


@pytest.mark.parametrize("base", [R.BASE, 1, (1 << 63) + 1])
def test_suffixes_are_sorted_whatever_the_hashes_say(monkeypatch, base):
    monkeypatch.setattr(R, "BASE", base)  # with a base of 1 every rearrangement collides
    draw = random.Random(4)
    body = np.array([draw.choice(b"ab") for _ in range(400)], np.uint8)
    at = np.array([draw.randrange(20, 380) for _ in range(200)])
    reach = np.array([draw.randrange(20) for _ in at])
    segment = np.sort(np.array([draw.randrange(5) for _ in at]))
    for leftward in (False, True):
        runs = [bytes(body[a - r : a][::-1] if leftward else body[a : a + r]) for a, r in zip(at, reach, strict=True)]
        order, common = R.sorted_runs(segment, R.Suffixes(body, R.prefix_hashes(body), at, reach, leftward))
        assert sorted(order) == list(range(200))
        listed = [(segment[k], runs[k]) for k in order]
        assert listed == sorted(listed)
        for (s, x), (t, y), n in zip(listed, listed[1:], common[1:], strict=False):
            same = next((k for k, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
            assert n == (same if s == t else -1)


def test_odd_rows_and_real_tag_texts(spark, odd_files, no_files):
    rows = [(r["file_id"], r["tag_text"]) for r in odd_files.where(F.length("tag_text") < 1000).collect()] + [(3, None), (None, None)]
    long_ = [r for r in found(odd_files) if r[1] > 10_000]
    assert [r for r in found(odd_files) if r[1] < 1000] == brute(rows, 50)
    assert [(r[0], len(r[2]), len(r[3])) for r in long_] == [(6, 0, long_[0][1]), (7, 1, 1)]
    assert found(no_files) == []
    tags = spark.createDataFrame([(f, "svc", p, f"tag number {p} of a series of long tags") for f in (1, 2) for p in range(5)], "file_id bigint, service_key string, pos bigint, tag string")
    assert [(r[0], r[2]) for r in found(tag_texts(tags))] == [(1, []), (2, [(0, 189)])]


def test_texts_are_shuffled_once(spark):
    df = R.repeated_runs(files(spark, (1, "a" * 60, None), (2, "a" * 60, None)))
    assert got(df, "file_id", "n_bytes") == [(1, 60), (2, 60)]
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 2

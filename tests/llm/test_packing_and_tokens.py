"""Tokens, packing and token files: equal ids, exact round trips, no padding."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import got
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagspark.llm import elias_fano, packing, token_files
from tagspark.llm.tokens import encoder
from tagspark.session import fresh_path

from .conftest import files, words

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    own = Tokenizer.from_file(VOCABULARY)
    own.encode_special_tokens = True
    return own


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcé日😀 \n\t\r\x0b  'sS.,1_<|>")) | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_words_encode_like_whole_texts(tokenizer, text):
    ids = np.frombuffer(encoder(VOCABULARY).encode(text), "<u4").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_special_token_text_is_ordinary(tokenizer):
    text = "a <|endoftext|> b<|endoftext|>"
    assert np.frombuffer(encoder(VOCABULARY).encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert 50256 not in tokenizer.encode(text).ids


def check_pieces(tokenizer, rows, pieces, size, end):
    """Every id in exactly one piece, sequences without gaps, and no padding."""
    wanted = defaultdict(list)
    for file_id, text in rows:
        wanted[file_id].append(ids_of(tokenizer, text, end))
    held, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert p["ids_crc32"] == zlib.crc32(p["ids"]) and p["length"] == len(ids) > 0
        held[p["file_id"]].append((p["start"], ids, p["doc_tokens"]))
        sequences[p["sequence_id"]].append((p["offset"], len(ids)))
    assert set(held) == set(wanted)
    for file_id, parts in held.items():
        if len(wanted[file_id]) > 1:  # repeated ids cannot be told apart
            assert sorted(i for _, ids, _ in parts for i in ids) == sorted(i for ids in wanted[file_id] for i in ids)
            continue
        parts.sort(key=lambda x: x[0])
        assert [i for _, ids, _ in parts for i in ids] == wanted[file_id][0]
        assert [s for s, _, _ in parts] == list(np.cumsum([0, *[len(ids) for _, ids, _ in parts]])[:-1])
        assert {n for _, _, n in parts} == {len(wanted[file_id][0])}
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *[n for _, n in parts]])[:-1])
        used = sum(n for _, n in parts)
        assert used <= size and used & used - 1 == 0
    return sequences


@pytest.mark.parametrize("size, window", [(16, 7), (64, 50), (1_024, 8_192)])
def test_packing_loses_and_pads_nothing(spark, tokenizer, size, window):
    draw = random.Random(size)
    rows = [(i, words(i, draw.choice([0, 1, 5, 30, 200]))) for i in range(120)]
    df = files(spark, *[(i, t, None) for i, t in rows]).repartition(3)
    packed = packing.pack_files(df, VOCABULARY, sequence_tokens=size, window_pieces=window)
    sequences = check_pieces(tokenizer, rows, packed.collect(), size, 0)
    total = sum(len(ids_of(tokenizer, t, 0)) for _, t in rows)
    assert len(sequences) <= total // size + 40 * size.bit_length()


def test_packing_odd_rows(spark, tokenizer, odd_files, no_files):
    rows = [(r["file_id"], r["tag_text"]) for r in odd_files.collect()]
    check_pieces(tokenizer, rows, packing.pack_files(odd_files, VOCABULARY).collect(), 1_024, 0)
    assert packing.pack_files(no_files, VOCABULARY).collect() == []
    assert packing.pack_files(odd_files, VOCABULARY, with_ids=False).where("ids is not null").count() == 0


def test_descending_pieces_go_to_the_cheapest_sequence():
    pieces = [(k, 0, bytes(4 * n), n) for k, n in enumerate([6, 5, 3, 2])]
    rows, n = packing.assign(pieces, 8, packing.Cost())
    assert n == 2
    placed = {(r[0], r[1]): (r[4], r[5], len(r[2]) // 4) for r in rows}
    assert placed == {(0, 0): (0, 0, 6), (1, 0): (1, 0, 5), (2, 0): (1, 5, 3), (3, 0): (0, 6, 2)}
    cut, n = packing.assign([(k, 0, bytes(4 * 5), 5) for k in range(3)], 8, packing.Cost())
    assert n == 4 and sum(len(r[2]) for r in cut) == 60 and max(r[5] + len(r[2]) // 4 for r in cut) == 8


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 62), max_size=300).map(sorted))
def test_elias_fano_round_trip(numbers):
    coded = elias_fano.EliasFano(elias_fano.encode(np.array(numbers, np.uint64)))
    assert coded.all().tolist() == numbers
    assert [coded.select(i) for i in range(len(numbers))] == numbers
    for i in (-1, len(numbers)):
        with pytest.raises(IndexError):
            coded.select(i)


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2_000, 10_000))
    assert len(elias_fano.encode(ends)) * 8 / len(ends) < 2 + np.log2(ends[-1] / len(ends)) + 1.5


@pytest.mark.parametrize("block_ids", [1, 300, 1 << 20])
def test_token_files_give_all_ids_back(spark, tokenizer, odd_files, block_ids):
    rows = [(r["file_id"], r["tag_text"]) for r in odd_files.collect()]
    path = fresh_path(spark, "token-test")
    token_files.write_token_files(odd_files, path, VOCABULARY, block_ids=block_ids)
    found = token_files.read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["file_id"] for r in found] == [f for f, _ in ordered]
    at = 0
    for row, (_, text) in zip(found, ordered, strict=True):
        ids = ids_of(tokenizer, text, 2)
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (at, len(ids), zlib.crc32(row["ids"]))
        at += len(ids)
    blocks = [b.asDict() for b in spark.read.parquet(path).orderBy("shard", "block").collect()]
    singly = [token_files.ids_of(b, i).tobytes() for b in blocks for i in range(len(elias_fano.EliasFano(b["ends"])))]
    assert singly == [bytes(r["ids"]) for r in found]


def test_one_id_in_half_of_all_rows_is_spread(spark, tokenizer):
    texts = [words(i, 6) for i in range(2_000)]
    df = files(spark, *[(None if i % 2 else i, text, None) for i, text in enumerate(texts)])
    path = fresh_path(spark, "token-test")
    token_files.write_token_files(df, path, VOCABULARY)
    found = token_files.read_token_files(spark, path, with_ids=True)
    most = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n")).agg(F.max("n") / F.sum("n")).first()[0]
    shards = spark.read.parquet(path).select("shard").distinct().count()
    assert most < 2 / shards
    nulls = [bytes(r["ids"]) for r in found.where("file_id IS NULL").orderBy("start").collect()]
    assert nulls == [np.array(ids_of(tokenizer, t, 2), "<u4").tobytes() for t in sorted(texts[1::2])]


def test_reading_decodes_no_list_of_ends(spark, monkeypatch):
    block = token_files._block(0, 0, [(i, np.arange(i + 1, dtype="<u4").tobytes()) for i in range(200)]).to_pylist()[0]
    decoded = []
    whole = elias_fano.EliasFano.all
    monkeypatch.setattr(elias_fano.EliasFano, "all", lambda coded: decoded.append(len(coded.high)) or whole(coded))
    rows = next(token_files._read([pa.RecordBatch.from_pylist([block], schema=token_files._BLOCK)], False))
    assert rows.column("n_tokens").to_pylist() == list(range(1, 201))
    assert decoded == [len(elias_fano.EliasFano(block["files"]).high)]


def test_token_files_of_nothing(spark, no_files):
    path = fresh_path(spark, "token-test")
    token_files.write_token_files(no_files, path, VOCABULARY)
    assert got(token_files.read_token_files(spark, path)) == []


def test_added_tokens_in_texts_are_those_of_the_plain_library(spark):
    plain = Tokenizer.from_file(VOCABULARY)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z  <|endoftext|>", "no such <|endof text|>", "one two"]
    df = files(spark, *[(i, t, None) for i, t in enumerate(texts)])
    check_pieces(plain, list(enumerate(texts)), packing.pack_files(df, VOCABULARY).collect(), 1_024, 0)
    path = fresh_path(spark, "token-test")
    token_files.write_token_files(df, path, VOCABULARY)
    found = {r["file_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.read_token_files(spark, path, with_ids=True).collect()}
    assert found == {i: ids_of(plain, t, 2) for i, t in enumerate(texts)}
    assert found[0][:-1] == [64, 220, 50256, 275]

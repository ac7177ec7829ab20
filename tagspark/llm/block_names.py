"""Exact duplicates by deterministic block naming.

A text without white space is cut into blocks of a fixed number of bytes. Equal blocks get the
same integer name by sorting them; then adjacent pairs of names are named in the same way, again
and again, until each file has one name. No digest decides anything: two files share a name
exactly if their texts are equal.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tagspark.session import cut_lineage

BLOCK_BYTES = 2_048
# Bytes of distinct blocks that a task remembers in order to number repeats only once.
MEMORY_BYTES = 32 << 20
# Rows that a task cuts at a time.
SLICE_ROWS = 1_000
# Numbers are the task's number followed by a running number inside the task.
TASK_BITS = 40

_CUT = (
    "row bigint, file_id bigint, key bigint, n_chars bigint, text_sha256 binary, "
    "blocks array<bigint>, number bigint, block binary"
)


def duplicate_files(
    files: DataFrame, block_bytes: int = BLOCK_BYTES, memory_bytes: int = MEMORY_BYTES, key: str | None = None
) -> DataFrame:
    """Every row of `files` with the identity of its text and the file that stays of its group.

    Texts are equal when they are identical after white space is deleted. Of equal texts the one
    with the most code points stays, then the smallest `file_id`. Returns file_id, keep_id,
    group_size, kept, text_sha256 (of the text without white space), identity (an integer name),
    level (how often pairs were named; names are unique within a level) and, if `key` names a column
    of whole numbers, that column.

    A null text counts as empty, all empty texts are one group. Rows that repeat a `file_id` count
    as rows, one of them stays. A null `file_id` comes after all others. An empty table gives an
    empty result; further columns are ignored.

    Each task numbers its own distinct blocks first, so a text that a third of all files share
    travels once per task. The rows of a copied text meet only in sums and in a join whose other
    side has one row per text.
    """
    rows = files.select("file_id", F.col(key or "file_id").cast("bigint").alias("key"), "tag_text")
    cut = cut_lineage(rows.mapInArrow(lambda batches: _cut(batches, block_bytes, memory_bytes), _CUT), "blocks")
    texts = cut.where("row is not null").select("row", "file_id", "key", "n_chars", "text_sha256", "blocks")
    named = _name_files(texts, _name_blocks(cut.where("number is not null").select("number", "block")))

    full = cut_lineage(texts.drop("blocks").join(named, "row"), "named-texts")
    best_first = F.struct(-F.col("n_chars"), F.col("file_id").isNull(), "file_id", "row")
    # Written before it is joined: only a join of two plain exchanges is split where a key is frequent.
    groups = cut_lineage(
        full.groupBy("level", "identity").agg(F.count("*").alias("group_size"), F.min(best_first).alias("keep")), "text-groups"
    )
    return full.join(groups, ["level", "identity"]).select(
        "file_id",
        F.col("keep.file_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
        "identity",
        "level",
        *([F.col("key").alias(key)] if key else []),
    )


def _cut(batches: Iterator[pa.RecordBatch], size: int, memory: int) -> Iterator[pa.RecordBatch]:
    """Texts as lists of block numbers, and each distinct block of the task with its number."""
    schema = pa.schema(
        [
            ("row", pa.int64()),
            ("file_id", pa.int64()),
            ("key", pa.int64()),
            ("n_chars", pa.int64()),
            ("text_sha256", pa.binary()),
            ("blocks", pa.list_(pa.int64())),
            ("number", pa.int64()),
            ("block", pa.binary()),
        ]
    )
    first = TaskContext.get().partitionId() << TASK_BITS
    rows = blocks = held = 0
    known: dict[bytes, int] = {}
    slices = (batch.slice(at, SLICE_ROWS) for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS))
    for batch in slices:
        texts = pc.fill_null(batch.column("tag_text"), "")
        chars = pc.utf8_length(texts)
        out_rows, digests, lists, new = [], [], [], []
        for text in pc.cast(texts, pa.binary()).to_pylist():
            plain = b"".join(text.split())
            numbers = []
            for at in range(0, max(1, len(plain)), size):
                block = plain[at : at + size]
                number = known.get(block)
                if number is None:
                    if held > memory:  # forgetting costs repeats in the sort, not correctness
                        known, held = {}, 0
                    number = known[block] = first + blocks
                    blocks, held = blocks + 1, held + len(block)
                    new.append((number, block))
                numbers.append(number)
            out_rows.append(first + rows)
            rows += len(numbers)
            digests.append(hashlib.sha256(plain).digest())
            lists.append(numbers)
        n = len(lists)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(out_rows, pa.int64()),
                pc.cast(batch.column("file_id"), pa.int64()),
                batch.column("key"),
                pc.cast(chars, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(lists, pa.list_(pa.int64())),
                pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.binary()),
            ],
            schema=schema,
        )
        empty = [pa.nulls(len(new), field.type) for field in schema][:6]
        yield pa.RecordBatch.from_arrays(
            [*empty, pa.array([x[0] for x in new], pa.int64()), pa.array([x[1] for x in new], pa.binary())],
            schema=schema,
        )


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """number -> name: after sorting, equal blocks are named by the least number among them."""
    return blocks.select("number", F.min("number").over(Window.partitionBy("block")).alias("name"))


def _name_files(texts: DataFrame, names: DataFrame) -> DataFrame:
    """row, level, identity: adjacent names are paired and named until one is left per row."""
    parts = (
        texts.select("row", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "number"))
        .join(names, "number")
        .select("row", "n", "pos", "name")
    )
    parts = cut_lineage(parts, "names-0")
    longest = parts.agg(F.max("n")).first()[0] or 1
    done = [_finished(parts, 0)]
    for level in range(1, math.ceil(math.log2(longest)) + 1):
        left, right = (F.max(F.when(F.col("pos") % 2 == side, F.col("name"))) for side in (0, 1))
        # An odd last name is paired with -1, which names nothing else.
        pairs = (
            parts.where("n > 1")
            .groupBy("row", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(left.alias("left"), F.coalesce(right, F.lit(-1)).alias("right"))
        )
        # Rows leave room for their blocks, so row + pos is another integer for each pair.
        named = pairs.groupBy("left", "right").agg(F.min(F.col("row") + F.col("pos")).alias("name"))
        named = cut_lineage(named, "pair-names")
        parts = cut_lineage(
            pairs.join(named, ["left", "right"]).select(
                "row", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name"
            ),
            f"names-{level}",
        )
        done.append(_finished(parts, level))
    out = done[0]
    for rows in done[1:]:
        out = out.unionByName(rows)
    return out


def _finished(parts: DataFrame, level: int) -> DataFrame:
    return parts.where("n = 1").select("row", F.lit(level).alias("level"), F.col("name").alias("identity"))

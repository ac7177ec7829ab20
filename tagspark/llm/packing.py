"""Packing tag texts into token sequences of equal length and similar attention cost.

A piece of n tokens costs linear * n + quadratic * n * n. Pieces are taken in descending order of
cost, and each goes to the sequence with the lowest cost so far among those it still fits in.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tagspark.llm.texts import whole_text
from tagspark.llm.tokens import ID_BYTES, encoder

SEQUENCE_TOKENS = 1_024
END_ID = 0
# Pieces that are packed together; a task holds so many in memory.
WINDOW_PIECES = 8_192
LINEAR_COST = 1.0
QUADRATIC_COST = 1.0 / SEQUENCE_TOKENS
# A sequence number is the task's number followed by a running number inside the task.
TASK_BITS = 40

PACKED = (
    "file_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, ids binary"
)


@dataclass(frozen=True)
class Cost:
    """What the attention of a piece costs."""

    linear: float = LINEAR_COST
    quadratic: float = QUADRATIC_COST

    def of(self, tokens: int) -> float:
        return self.linear * tokens + self.quadratic * tokens * tokens


def pack_files(
    files: DataFrame,
    vocabulary: str,
    sequence_tokens: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
    cost: Cost = Cost(),
    window_pieces: int = WINDOW_PIECES,
    with_ids: bool = True,
) -> DataFrame:
    """The pieces of all rows of `files` (file_id, tag_text) and where they lie.

    A file's ids are those of its whole text by the vocabulary file at `vocabulary` and `end_id`.
    Returns per piece: file_id, start (its file's ids before it), length, ids_crc32, doc_tokens
    (ids of the file), sequence_id, offset (in the sequence, without gaps from 0) and the ids
    (unsigned 32-bit, little-endian; null unless `with_ids`).

    Texts longer than a sequence are cut into whole sequences and a rest. Among the pieces that a
    task packs together (`window_pieces` at least, or what the task has), the sequences offered
    hold exactly as many tokens as the pieces: full ones, and for what is left over one for each
    power of two in it, which needs no padding. A piece that fits nowhere is cut over the
    sequences of the lowest cost, so no token is padding.

    A null or empty text is its end id alone. Null file ids and repeated rows are packed like any
    other row, further columns are ignored, and an empty table gives no pieces. Nothing is
    shuffled; the order of the input decides which texts share a sequence.
    """
    return files.select("file_id", whole_text().alias("tag_text")).mapInArrow(
        lambda batches: _pack(batches, vocabulary, sequence_tokens, end_id, cost, window_pieces, with_ids), PACKED
    )


def _pack(batches, vocabulary, size, end_id, cost, window, with_ids) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary, added_tokens=True).encode
    end = int(end_id).to_bytes(ID_BYTES, "little")
    task = TaskContext.get().partitionId() << TASK_BITS
    next_sequence = 0
    held: list[tuple] = []
    for batch in batches:
        for file_id, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            ids = encode(text) + end
            n = len(ids) // ID_BYTES
            for start in range(0, n, size):
                held.append((file_id, start, ids[start * ID_BYTES : (start + size) * ID_BYTES], n))
            if len(held) >= window:
                rows, used = assign(held, size, cost)
                yield _batch(rows, task + next_sequence, with_ids)
                next_sequence, held = next_sequence + used, []
    if held:
        rows, used = assign(held, size, cost)
        yield _batch(rows, task + next_sequence, with_ids)


def assign(pieces: list[tuple], size: int, cost: Cost) -> tuple[list[tuple], int]:
    """Pieces (file_id, start, ids, n) with their sequence and offset; the number of sequences."""
    order = sorted(pieces, key=lambda p: -len(p[2]))
    total = sum(len(p[2]) for p in pieces) // ID_BYTES
    full, rest = divmod(total, size)
    rooms = [size] * full + [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]
    # A heap by cost; a sequence that has no room for a piece has none for an earlier, longer one
    # either, so it waits in `waiting` until pieces are short enough for it.
    free = [(0.0, k) for k in range(len(rooms))]
    left = list(rooms)
    waiting: list[tuple[int, float, int]] = []
    out, uncut = [], []
    for file_id, start, ids, n in order:
        length = len(ids) // ID_BYTES
        while waiting and -waiting[0][0] >= length:
            room, spent, k = heapq.heappop(waiting)
            heapq.heappush(free, (spent, k))
        while free and left[free[0][1]] < length:
            spent, k = heapq.heappop(free)
            if left[k]:
                heapq.heappush(waiting, (-left[k], spent, k))
        if not free:
            uncut.append((file_id, start, ids, n))
            continue
        spent, k = heapq.heappop(free)
        out.append((file_id, start, ids, n, k, rooms[k] - left[k]))
        left[k] -= length
        heapq.heappush(free, (spent + cost.of(length), k))
    open_ = sorted([(spent, k) for spent, k in free if left[k]] + [(s, k) for _, s, k in waiting])
    at = 0
    for file_id, start, ids, n in uncut:
        while ids:
            k = open_[at][1]
            part, ids = ids[: left[k] * ID_BYTES], ids[left[k] * ID_BYTES :]
            out.append((file_id, start, part, n, k, rooms[k] - left[k]))
            start, left[k] = start + len(part) // ID_BYTES, left[k] - len(part) // ID_BYTES
            at += not left[k]
    return out, len(rooms)


def _batch(rows: list[tuple], first_sequence: int, with_ids: bool) -> pa.RecordBatch:
    file_ids, starts, ids, tokens, sequences, offsets = zip(*rows, strict=True)
    whole = pa.int64()
    return pa.RecordBatch.from_pydict(
        {
            "file_id": pa.array(file_ids, whole),
            "start": pa.array(starts, whole),
            "length": pa.array([len(x) // ID_BYTES for x in ids], whole),
            "ids_crc32": pa.array([zlib.crc32(x) for x in ids], whole),
            "doc_tokens": pa.array(tokens, whole),
            "sequence_id": pa.array([first_sequence + k for k in sequences], whole),
            "offset": pa.array(offsets, whole),
            "ids": pa.array(ids if with_ids else [None] * len(ids), pa.binary()),
        }
    )

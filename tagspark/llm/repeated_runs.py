"""Byte runs of tag texts that earlier files hold already, by a hash-compared suffix sort.

Every run of `length` bytes is named after one short gram inside it, the one whose digest is the
least; equal runs choose the same gram, at the same place. So texts are cut into pieces, each with
all runs of one gram, and only grams that stand in several places travel. Where equal grams meet,
the suffixes that begin at them and the prefixes that end there are sorted by mergesort. Two of
them are compared by a binary search for their common extension over prefix polynomial hashes, so
a comparison takes a logarithm of the length. What the hashes claim is verified byte by byte, and
sorted anew without hashes if a claim is wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from tagspark.llm.texts import whole_text

LENGTH = 50
# Longest gram; shorter ones are used for short runs.
GRAM = 16
# Blocks of texts for each shuffle partition.
PER_PARTITION = 4
# Bytes of pieces that a task sorts at a time, all pieces of a gram together.
SORT_BYTES = 1 << 23
# A gram of more pieces than this, equal ones of a block counted once, is dealt out by whole runs: about half of SORT_BYTES.
HOT_PIECES = 1 << 16
# Blocks whose spans are sent at a time.
SPAN_ROWS = 1_000
# Bytes that are hashed at once, less than 2 ** PLACE_BITS.
CHUNK = 1 << 20
PLACE_BITS = 22
CODEC = pa.Codec("zstd", compression_level=5)

BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2 ** 64."""
    held = _powers.get(BASE)
    if held is None or len(held[0]) < n:
        size = max(n, CHUNK + 1)
        both = []
        for factor in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size, factor, _U)
            steps[0] = 1
            both.append(np.cumprod(steps))
        held = _powers[BASE] = (both[0], both[1])
    return held


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, the empty one included."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def run_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end), wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ value >> _U(31)) * _U(0xBF58476D1CE4E5B9)
    value = (value ^ value >> _U(29)) * _U(0x94D049BB133111EB)
    return value ^ value >> _U(32)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of `width` values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the stretches of `size` from `start` on, end to end."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def gram_of(length: int) -> int:
    return max(1, min(GRAM, length // 3))


class Chunk:
    """Pieces of some bytes: all runs of one gram that stand next to each other."""

    def __init__(self, parts: Sequence[bytes], units: Sequence[tuple[int, int, int]], length: int) -> None:
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.prefix = prefix_hashes(self.data)
        n, gram = len(self.data), gram_of(length)
        at = np.arange(n - gram + 1)
        names = _mixed(run_hash(self.prefix, at, at + gram))
        mask = _U((1 << PLACE_BITS) - 1)
        least = _least(names & ~mask | at.astype(_U), length - gram + 1)
        inside = np.ones(len(least), bool)
        places = np.array([u[2] for u in units])
        for end in [*places[1:].tolist(), n]:
            inside[max(0, end - length + 1) : end] = False
        runs = np.flatnonzero(inside)
        chosen = least[runs]
        opens = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (np.diff(runs) != 1)]))
        anchor = (chosen[opens] & mask).astype(np.int64)
        self.first = runs[opens]
        self.size = np.diff(np.append(opens, len(runs))) + length - 1
        self.left = anchor - self.first
        self.key = names[anchor] >> _U(16)
        unit = np.searchsorted(places, self.first, "right") - 1
        docs, offsets = np.array([u[0] for u in units]), np.array([u[1] for u in units])
        self.doc = docs[unit]
        self.start = offsets[unit] + self.first - places[unit]


def chunks_of(texts: Sequence[bytes], length: int) -> Iterator[Chunk]:
    """Texts in chunks of bounded size; a long text lies in several, which share length - 1 bytes."""
    parts: list[bytes] = []
    units: list[tuple[int, int, int]] = []
    size = 0
    most = max(CHUNK, 2 * length)
    for doc, text in enumerate(texts):
        at = 0
        while len(text) - at >= length:
            take = min(len(text) - at, most - size)
            if take < length:
                yield Chunk(parts, units, length)
                parts, units, size = [], [], 0
                continue
            parts.append(text[at : at + take])
            units.append((doc, at, size))
            size += take
            at += take - length + 1
    if parts:
        yield Chunk(parts, units, length)


# Bytes that travel: named arrays end to end, compressed.


def _packed(*arrays: np.ndarray) -> bytes:
    body = b"".join(a.tobytes() for a in arrays)
    head = np.array([len(arrays), len(body), *[a.nbytes for a in arrays]], np.int64).tobytes()
    return head + CODEC.compress(body, asbytes=True)


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    n, size = np.frombuffer(data, np.int64, 2).tolist()
    sizes = np.frombuffer(data, np.int64, n, 16).tolist()
    body = CODEC.decompress(memoryview(data)[16 + 8 * n :], size, asbytes=True)
    out, at = [], 0
    for nbytes, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(body, kind, nbytes // np.dtype(kind).itemsize, at))
        at += nbytes
    return out


def _stretches(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The rows of an array between the edges, as binary values without a call for each."""
    return pa.Array.from_buffers(
        pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * (data.nbytes // max(1, len(data)))).astype(np.int32)), pa.py_buffer(data)]
    )


def _joined(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _order_of(file_id: int | None) -> int:
    """Ids as unsigned numbers in the same order; null comes last."""
    return _MASK if file_id is None else (file_id + (1 << 63)) & _MASK


def _pack_texts(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Texts of a batch dealt into blocks by their content and id; equal rows of a batch are counted once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts = batch.column("file_id").to_pylist(), pc.cast(batch.column("tag_text"), pa.binary()).to_pylist()
        copies: dict[tuple[int | None, bytes], int] = {}
        for row in zip(ids, texts, strict=True):
            copies[row] = copies.get(row, 0) + 1
        dealt: dict[int, list] = {}
        for (file_id, text), n in copies.items():
            order = _order_of(file_id)
            dealt.setdefault(xxhash.xxh3_64_intdigest(text, order) % blocks, []).append((order, file_id is None, n, text))
        rows = []
        for found in dealt.values():
            rows.append(
                _packed(
                    np.array([f[0] for f in found], _U),
                    np.array([f[1] for f in found], np.uint8),
                    np.array([f[2] for f in found], np.int64),
                    np.array([len(f[3]) for f in found], np.int64),
                    np.frombuffer(b"".join(f[3] for f in found), np.uint8),
                )
            )
        yield pa.RecordBatch.from_arrays([pa.array(list(dealt), pa.int32()), pa.array(rows, pa.binary())], names=["block", "texts"])


class Block:
    """The texts of a block in an order that depends on them alone."""

    def __init__(self, table: pa.Table) -> None:
        rows: dict[tuple[int, bool, bytes], int] = {}
        for data in table.column("texts").to_pylist():
            order, null, copies, sizes, body = _unpacked(data, "u8", "u1", "i8", "i8", "u1")
            text, at = body.tobytes(), 0
            for o, is_null, n, size in zip(order.tolist(), null.tolist(), copies.tolist(), sizes.tolist(), strict=True):
                row = (o, bool(is_null), text[at : at + size])
                rows[row] = rows.get(row, 0) + n
                at += size
        found = sorted(rows)
        self.number = table.column("block")[0].as_py() if table.num_rows else None
        self.order = np.array([r[0] for r in found], _U)
        self.ids = [None if r[1] else r[0] - (1 << 63) for r in found]
        self.texts = [r[2] for r in found]
        self.copies = [rows[r] for r in found]

    def keys(self, chunks: Sequence[Chunk], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys by bucket, the place of each piece's key, keys that repeat here, and where a bucket begins."""
        every = np.concatenate([np.zeros(0, _U), *[c.key for c in chunks]])
        distinct, place, times = np.unique(every, return_inverse=True, return_counts=True)
        bucket = (distinct % _U(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        return distinct[by], rank[place], times[by] > 1, np.searchsorted(bucket[by], np.arange(buckets + 1))


def _send_keys(table: pa.Table, length: int, buckets: int) -> pa.Table:
    """The distinct grams of a block, 48 bits each, and how many different pieces have each."""
    block = Block(table)
    chunks = list(chunks_of(block.texts, length))
    distinct, place, _, cuts = block.keys(chunks, buckets)
    names = [run_hash(c.prefix, c.first, c.first + c.size) for c in chunks]
    firsts = np.unique(np.concatenate([np.zeros(0, _U), *names]), return_index=True)[1]
    pieces = np.bincount(place[firsts], minlength=len(distinct)).astype(np.uint32)
    numbers = np.flatnonzero(np.diff(cuts))
    edges = np.append(cuts[numbers], len(distinct))
    return pa.table(
        {
            "bucket": pa.array(numbers, pa.int32()),
            "block": pa.array([block.number] * len(numbers), pa.int32()),
            "keys": _stretches(np.ascontiguousarray(distinct.view(np.uint8).reshape(-1, 8)[:, :6]), edges),
            "pieces": _stretches(pieces, edges),
        }
    )


# Marks of a key.
SHARED, HOT = 1, 2


def _mark_keys(batches: Iterator[pa.RecordBatch], hot_blocks: int | None, hot_pieces: int) -> Iterator[pa.RecordBatch]:
    """For each key of each block whether other blocks have it, and whether very many pieces do."""
    found, pieces, sizes = [np.zeros(0, _U)], [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
    blocks, buckets = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for batch in batches:
        planes = _joined(batch.column("keys"), "u1").reshape(-1, 6)
        keys = np.zeros((len(planes), 8), np.uint8)
        keys[:, :6] = planes
        found.append(keys.view(_U).ravel())
        pieces.append(_joined(batch.column("pieces"), "u4"))
        sizes.append(pc.binary_length(batch.column("keys")).to_numpy(zero_copy_only=False) // 6)
        blocks.append(batch.column("block").to_numpy(zero_copy_only=False))
        buckets.append(batch.column("bucket").to_numpy(zero_copy_only=False))
    _, place, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    many = np.bincount(place, np.concatenate(pieces), len(times)) > hot_pieces
    if hot_blocks is not None:
        many |= times > hot_blocks
    marks = (SHARED * (times > 1) + HOT * many).astype(np.uint8)[place]
    edges = np.cumsum(np.concatenate(sizes))
    columns = [pa.array(np.concatenate(blocks)), pa.array(np.concatenate(buckets)), _stretches(marks, edges)]
    yield pa.RecordBatch.from_arrays(columns, names=["block", "bucket", "marks"])


def _leaders(body: np.ndarray, offset: np.ndarray, size: np.ndarray, name: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each piece the first one of the smallest order that equals it, byte by byte."""
    by = np.lexsort((order, size, name))
    out = np.arange(len(by))
    if len(by):
        opens = np.concatenate([[True], (name[by][1:] != name[by][:-1]) | (size[by][1:] != size[by][:-1])])
        first = by[np.maximum.accumulate(np.where(opens, np.arange(len(by)), 0))]
        claims = by != first
        mine, theirs = by[claims], first[claims]
        same = _equal(body, offset[mine], offset[theirs], size[mine])
        out[mine[same]] = theirs[same]
    return out


# Stands for a bucket where spans are known already.
KNOWN = -1


def _send_pieces(texts: pa.Table, marks: pa.Table, length: int, buckets: int) -> pa.Table:
    """Pieces whose gram stands elsewhere too, once for equal pieces of the block; what that leaves out is known to be covered."""
    block = Block(texts)
    chunks = list(chunks_of(block.texts, length))
    _, place, shared, _ = block.keys(chunks, buckets)
    marked = _joined(marks.sort_by("bucket").column("marks"), "u1")  # in the order of the keys
    shared |= marked & SHARED > 0
    hot = marked & HOT > 0
    columns: list[list[np.ndarray]] = [[] for _ in range(7)]
    at = 0
    for chunk in chunks:
        own = place[at : at + len(chunk.key)]
        at += len(own)
        whole = np.flatnonzero(shared[own] & ~hot[own])
        split = np.flatnonzero(hot[own])
        runs = chunk.size[split] - length + 1
        # A hot gram's runs go one by one, each by its own digest.
        piece, step = np.repeat(split, runs), _spread(np.zeros(len(split), np.int64), runs)
        first = np.concatenate([chunk.first[whole], chunk.first[piece] + step])
        size = np.concatenate([chunk.size[whole], np.full(len(piece), length)])
        name = run_hash(chunk.prefix, first, first + size)
        key = np.concatenate([chunk.key[whole], _mixed(name[len(whole) :]) >> _U(16)])
        added = (
            np.concatenate([chunk.doc[whole], chunk.doc[piece]]),
            np.concatenate([chunk.start[whole], chunk.start[piece] + step]),
            size,
            np.concatenate([chunk.left[whole], chunk.left[piece] - step]),
            key,
            name,
            chunk.data[_spread(first, size)],
        )
        for column, values in zip(columns, added, strict=True):
            column.append(values)
    empty = (np.int64, np.int64, np.int64, np.int64, _U, _U, np.uint8)
    doc, start, size, left, key, name, body = (np.concatenate([np.zeros(0, k), *c]) for c, k in zip(columns, empty, strict=True))
    offset = np.cumsum(size) - size
    order = block.order[doc] if len(doc) else np.zeros(0, _U)
    leader = _leaders(body, offset, size, name, order)
    covered = order > order[leader]
    numbers, rows = [], []
    if covered.any():
        numbers.append(KNOWN)
        rows.append(_packed(doc[covered], start[covered], size[covered]))
    # Of equal pieces of one text the bytes are sent once, with all places.
    bucket = (key % _U(buckets)).astype(np.int64)
    sent = np.flatnonzero(~covered)
    sent = sent[np.lexsort((start[sent], doc[sent], leader[sent], bucket[sent]))]
    edges = np.searchsorted(bucket[sent], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        own = sent[edges[b] : edges[b + 1]]
        opens = np.flatnonzero(np.concatenate([[True], leader[own][1:] != leader[own][:-1]]))
        lead = own[opens]
        rows.append(
            _packed(
                np.diff(order[lead], prepend=_U(0)),
                size[lead].astype(np.uint16),
                left[lead].astype(np.uint16),
                np.diff(np.append(opens, len(own))).astype(np.uint32),
                np.diff(doc[own], prepend=0).astype(np.int32),
                start[own],
                body[_spread(offset[lead], size[lead])],
            )
        )
        numbers.append(b)
    return pa.table(
        {"bucket": pa.array(numbers, pa.int32()), "block": pa.array([block.number] * len(rows), pa.int32()), "pieces": pa.array(rows, pa.binary())}
    )


def _equal(body: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches of `size` bytes at a and b are equal, byte by byte."""
    out = np.ones(len(a), bool)
    some = np.flatnonzero(size > 0)
    if len(some):
        same = body[_spread(a[some], size[some])] == body[_spread(b[some], size[some])]
        out[some] = np.logical_and.reduceat(same, np.cumsum(size[some]) - size[some])
    return out


class Suffixes:
    """Runs of bytes from some places on, to the right or to the left, and how they compare."""

    def __init__(
        self, body: np.ndarray, prefix: np.ndarray, at: np.ndarray, reach: np.ndarray, leftward: bool = False
    ) -> None:
        self.body, self.prefix, self.at, self.reach, self.leftward = body, prefix, at, reach, leftward

    def _hash(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = self.at[x]
        return run_hash(self.prefix, at - size, at) if self.leftward else run_hash(self.prefix, at, at + size)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes in which two runs agree from their places on, by binary search."""
        high = np.minimum(self.reach[x], self.reach[y])
        low = np.where(self._hash(x, high) == self._hash(y, high), high, 0)  # often they agree to the end
        high = np.maximum(high - 1, low)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) >> 1
            same = self._hash(x[open_], mid) == self._hash(y[open_], mid)
            low[open_] = np.where(same, mid, low[open_])
            high[open_] = np.where(same, high[open_], mid - 1)

    def _byte(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The byte after so many, plus one; 0 at the end."""
        inside = size < self.reach[x]
        at = self.at[x] - 1 - size if self.leftward else self.at[x] + size
        return np.where(inside, self.body[np.where(inside, at, 0)].astype(np.int64) + 1, 0)

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Negative, zero or positive as x comes before, with or after y."""
        size = self.common(x, y)
        return self._byte(x, size) - self._byte(y, size)

    def verified(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> bool:
        """Whether x and y agree in `size` bytes, in no more, and x does not come after y."""
        step = self._byte(x, size) - self._byte(y, size)
        if (step > 0).any() or ((step == 0) & (size < self.reach[x])).any():
            return False
        a, b = (self.at[k] - size if self.leftward else self.at[k] for k in (x, y))
        return bool(_equal(self.body, a, b, size).all())


def merge_sort(segment: np.ndarray, compare: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The order of elements inside their segments, which stand one after the other.

    Runs of 1, 2, 4, ... are merged in all segments at once: each element finds its rank in the
    run next to its own by binary search.
    """
    n = len(segment)
    order = np.arange(n)
    if not n:
        return order
    opens = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    sizes = np.diff(np.append(opens, n))
    begin, size = np.repeat(opens, sizes), np.repeat(sizes, sizes)
    width = 1
    while width < sizes.max():
        slot = np.flatnonzero(size > width)
        place = slot - begin[slot]
        run = place // width
        base = begin[slot] + run // 2 * 2 * width
        middle = base + width
        end = np.minimum(base + 2 * width, begin[slot] + size[slot])
        has = middle < end
        slot, place, run, base, middle, end = (v[has] for v in (slot, place, run, base, middle, end))
        is_left = run % 2 == 0
        low, high = np.where(is_left, middle, base), np.where(is_left, end, middle)
        from_, element = low.copy(), order[slot]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            step = compare(element[open_], order[mid])
            later = np.where(is_left[open_], step > 0, step >= 0)
            low[open_] = np.where(later, mid + 1, low[open_])
            high[open_] = np.where(later, high[open_], mid)
        merged = order.copy()
        merged[base + place % width + low - from_] = element
        order = merged
        width *= 2
    return order


def _plain_sort(segment: np.ndarray, runs: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Order and common lengths without hashes."""
    most = int(runs.reach.max(initial=0)) + 1
    every = np.arange(len(segment))
    grid = np.stack([runs._byte(every, np.full(len(every), k)) for k in range(most)], axis=1)
    order = np.lexsort((*grid.T[::-1], segment))
    sorted_ = grid[order]
    same = np.cumprod((sorted_[1:] == sorted_[:-1]) & (sorted_[1:] > 0), axis=1).sum(axis=1)
    return order, np.concatenate([[0], same])


def sorted_runs(segment: np.ndarray, runs: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Order of the runs in their segments, and what each has in common with the one before; -1 where a segment begins."""
    order = merge_sort(segment, runs.compare)
    x, y = order[:-1], order[1:]
    inside = segment[x] == segment[y]
    common = np.full(len(order), -1)
    size = runs.common(x[inside], y[inside])
    if runs.verified(x[inside], y[inside], size):
        common[1:][inside] = size
    else:
        order, plain = _plain_sort(segment, runs)
        inside = segment[order[1:]] == segment[order[:-1]]
        common[1:][inside] = plain[1:][inside]
    return order, common


def _find_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of pieces that earlier texts hold, by block."""
    gram = gram_of(length)
    kinds = ("u8", "u2", "u2", "u4", "i4", "i8", "u1")
    parts: list[list[np.ndarray]] = [[] for _ in range(9)]
    for batch in batches:
        known = pc.equal(batch.column("bucket"), KNOWN)
        yield pa.RecordBatch.from_arrays([c.filter(known) for c in batch.columns[1:]], names=["block", "spans"])
        rest = batch.filter(pc.invert(known))
        for block, data in zip(rest.column("block").to_pylist(), rest.column("pieces").to_pylist(), strict=True):
            orders, size, left, times, docs, start, body = _unpacked(data, *kinds)
            anchor = np.cumsum(size, dtype=np.int64) - size + left
            high, low = _grams(body, anchor, gram)
            share = (_mixed(high ^ low * _U(BASE)) >> _U(32)).astype(np.uint32)
            own = np.full(len(size), block, np.int32), np.cumsum(orders), size, left, share, times, np.cumsum(docs, dtype=np.int32), start, body
            for part, values in zip(parts, own, strict=True):
                part.append(values)
    if not parts[0]:
        return
    columns = []
    for part in parts:  # one after the other, so that only one is held twice
        columns.append(np.concatenate(part))
        part.clear()
    block, order, size, left, share, times, doc, start, body = columns
    share %= np.uint32(1 + len(body) // SORT_BYTES)
    size, left, times = (v.astype(np.int64) for v in (size, left, times))
    offset, listed = np.cumsum(size) - size, np.cumsum(times) - times
    spans: list[list[np.ndarray]] = [[] for _ in range(4)]
    for k in range(int(share.max()) + 1):
        own = np.flatnonzero(share == k)
        piece, place, reach = _covered(order[own], size[own], left[own], body[_spread(offset[own], size[own])], length)
        piece = own[piece]
        # What holds for a piece holds at all its places.
        n = times[piece]
        at = _spread(listed[piece], n)
        found = np.repeat(block[piece], n), doc[at], start[at] + np.repeat(place, n), np.repeat(reach, n)
        for column, values in zip(spans, found, strict=True):
            column.append(values)
    holder, *columns = (np.concatenate(c) for c in spans)
    by = np.argsort(holder, kind="stable")
    numbers, starts = np.unique(holder[by], return_index=True)
    doc, start, reach = (c[by].astype(np.int64) for c in columns)
    ends = np.append(starts[1:], len(by))
    for low in range(0, len(numbers), SPAN_ROWS):
        cuts = [slice(*c) for c in zip(starts[low : low + SPAN_ROWS].tolist(), ends[low : low + SPAN_ROWS].tolist(), strict=True)]
        rows = [_packed(doc[c], start[c], reach[c]) for c in cuts]
        yield pa.RecordBatch.from_arrays([pa.array(numbers[low : low + SPAN_ROWS], pa.int32()), pa.array(rows, pa.binary())], names=["block", "spans"])


def _grams(body: np.ndarray, anchor: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each gram as two numbers."""
    grams = np.zeros((len(anchor), GRAM), np.uint8)
    grams[:, :gram] = body[anchor[:, None] + np.arange(gram)]
    high, low = grams.view(">u8").astype(_U).T
    return high, low


def _covered(order: np.ndarray, size: np.ndarray, left: np.ndarray, body: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Pieces, and stretches of them, that stand in a text of a smaller order."""
    gram, offset = gram_of(length), np.cumsum(size) - size
    prefix = prefix_hashes(body)
    high, low = _grams(body, offset + left, gram)
    leader = _leaders(body, offset, size, run_hash(prefix, offset, offset + size), order)
    repeated = order > order[leader]
    again = np.flatnonzero(repeated)
    ready = again, np.zeros(len(again), np.int64), size[again]
    by = np.lexsort((order, low, high))
    by = by[~repeated[by]]
    if not len(by):
        return ready
    opens = np.concatenate([[True], (high[by][1:] != high[by][:-1]) | (low[by][1:] != low[by][:-1])])
    at = np.flatnonzero(opens)
    sizes = np.diff(np.append(at, len(by)))
    several = np.repeat(order[by[at]] < order[by[at + sizes - 1]], sizes)
    by, segment = by[several], np.repeat(np.arange(len(at)), sizes)[several]
    anchor = offset + left
    # In a segment pieces stand by their order; first those go whose right sides agree too little.
    place, right_common, best_right = _sorted_places(segment, Suffixes(body, prefix, anchor[by], (size - left)[by]))
    near = best_right >= length - left[by]
    by, segment = by[near], segment[near]
    place, right_common, best_right = _sorted_places(segment, Suffixes(body, prefix, anchor[by], (size - left)[by])) if not near.all() else (place, right_common, best_right)
    left_place, left_common, best_left = _sorted_places(segment, Suffixes(body, prefix, anchor[by], left[by], leftward=True))
    order, left_, size_ = order[by], left[by], size[by]
    most = np.minimum(best_left, left_)
    found, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for before in range(length - gram + 1):
        # Runs that begin so many bytes before the gram: equal if both sides are in one interval.
        has = np.flatnonzero((before <= most) & (best_right >= length - before) & (left_ - before + length <= size_))
        if len(has) < 2:
            continue
        right = np.cumsum(right_common < length - before)[place[has]]
        mine = right * (len(by) + 1) + np.cumsum(left_common < before)[left_place[has]]
        sort = np.argsort(mine, kind="stable")
        opens = np.concatenate([[True], mine[sort][1:] != mine[sort][:-1]])
        first = np.maximum.accumulate(np.where(opens, np.arange(len(sort)), 0))
        late = has[sort[order[has[sort]] > order[has[sort[first]]]]]
        found.append(late)
        places.append(left_[late] - before)
    piece, at = np.concatenate(found), np.concatenate(places)
    sort = np.lexsort((at, piece))
    piece, at = piece[sort], at[sort]
    new = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (np.diff(at) > length)])) if len(piece) else piece
    ends = np.append(new[1:], len(piece)) - 1 if len(piece) else piece
    found_ = by[piece[new]], at[new], at[ends] - at[new] + length
    return tuple(np.concatenate(c) for c in zip(ready, found_, strict=True))


def _sorted_places(segment: np.ndarray, runs: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each run in sorted order, common lengths along that order, and the longest one of each run with another."""
    order, common = sorted_runs(segment, runs)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    after = np.append(common[1:], -1)
    return place, common, np.maximum(common, after)[place]


RESULT = "file_id bigint, n_bytes bigint, spans array<struct<start:bigint,length:bigint>>, kept binary"


def _cut_texts(texts: pa.Table, spans: pa.Table) -> pa.Table:
    """Each text of a block without its spans."""
    block = Block(texts)
    parts = [_unpacked(data, "i8", "i8", "i8") for data in spans.column("spans").to_pylist()]
    doc, start, size = (np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]]) for k in range(3))
    by = np.lexsort((start, doc))
    doc, start, size = doc[by], start[by], size[by]
    merged: list[list[list[int]]] = [[] for _ in block.texts]
    for d, low, n in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True):
        own = merged[d]
        if own and low <= own[-1][1]:
            own[-1][1] = max(own[-1][1], low + n)
        else:
            own.append([low, low + n])
    rows = []
    for file_id, text, own, copies in zip(block.ids, block.texts, merged, block.copies, strict=True):
        at, kept = 0, []
        for low, high in own:
            kept.append(text[at:low])
            at = high
        kept.append(text[at:])
        found = [{"start": low, "length": high - low} for low, high in own]
        rows += [(file_id, len(text), found, b"".join(kept))] * copies
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    kinds = (("file_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary()))
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})


def repeated_runs(files: DataFrame, length: int = LENGTH, hot_blocks: int | None = None, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """Bytes of each row of `files` (file_id, tag_text) that earlier files hold, and the text without them.

    Texts are taken as UTF-8. A byte is repeated if it lies in a string of `length` bytes that also
    stands in a text with a smaller id. Strings are judged on the texts as they are, never across
    two texts; all overlapping ones count. Returns one row per row: file_id, n_bytes, `spans`, the
    maximal repeated runs as (start, length) in bytes, and `kept`, the other bytes end to end,
    which may cut characters.

    Null and empty texts, and texts shorter than `length`, have no spans. A null id comes after all
    others (it ties with the largest number); rows with equal ids are not earlier than each other,
    so repeated rows come out alike. An empty table gives no rows, further columns are ignored.

    Texts are dealt once into blocks by content and id. Of each block the distinct grams travel as
    48 bits each, come back with a mark if other blocks have them, and only pieces with such a gram
    are sent, one for equal pieces of a block. Grams of more than `hot_pieces` such pieces, or in more
    than `hot_blocks` blocks if that is given, are dealt out by whole runs, so no gram's pieces gather
    without bound. Blocks grow in number with the table, so by blocks ever more grams are dealt out
    that few pieces have, each at many times its bytes. What a task keeps in memory, a block of
    texts or its share of the pieces, is a share of the table that `spark.sql.shuffle.partitions`
    sets. `length` is at least 3.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = PER_PARTITION * n
    rows = files.select(F.col("file_id").cast("bigint").alias("file_id"), whole_text().alias("tag_text"))
    texts = rows.mapInArrow(lambda b: _pack_texts(b, blocks), "block int, texts binary").repartition(n, "block")
    keys = texts.groupBy("block").applyInArrow(lambda t: _send_keys(t, length, n), "bucket int, block int, keys binary, pieces binary")
    marks = keys.repartitionById(n, F.col("bucket")).mapInArrow(
        lambda b: _mark_keys(b, hot_blocks, hot_pieces), "block int, bucket int, marks binary"
    )
    pieces = texts.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(
        lambda t, m: _send_pieces(t, m, length, n), "bucket int, block int, pieces binary"
    )
    goes_to = F.when(F.col("bucket") == KNOWN, F.col("block") % n).otherwise(F.col("bucket"))
    spans = pieces.repartitionById(n, goes_to).mapInArrow(
        lambda b: _find_runs(b, length), "block int, spans binary"
    )
    return texts.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_cut_texts, RESULT)

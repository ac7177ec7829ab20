"""Near-duplicate tag texts by SimHash and a self-join of the binary trie of fingerprints.

Two nodes of the trie are walked down together; the bits in which their paths differ add up, and a
pair is dropped as soon as it has more differing bits than allowed at its depth. If two
fingerprints differ in at most k bits and are cut into k + 1 stretches, then starting from one of
the stretches (and going round) every run of j stretches holds less than j differing bits. So one
trie per starting stretch is walked, with none allowed in the first stretch, one up to the end of
the second, and so on; this finds every pair and leaves few node pairs alive.

The first stretch splits each trie into parts that do not meet, which Spark deals out. A part with
too many fingerprints for one task is walked down in Spark, four bits at a time, until its node
pairs are small; the rest of a walk happens inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from tagspark.llm.components import components
from tagspark.llm.texts import whole_text
from tagspark.session import cut_lineage

BITS = 64
SEED = 42
SHINGLE_WORDS = 4
MAX_DIFFERENCE = 4
# Fingerprints of a node pair that one task walks on alone.
NODE_ROWS = 16_384
# Bits per step of the walk in Spark.
STEP = 4
# Comparisons that end a walk instead of further splits, and those made at a time.
LEAF_PAIRS = 256
CHUNK_PAIRS = 1 << 20
# Digests counted at a time.
CHUNK_DIGESTS = 1 << 15


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of a UTF-8 text: the majority of each bit over the digests of its shingles."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK_DIGESTS):
        some = range(at, min(n, at + CHUNK_DIGESTS))
        digests = np.array([digest(join(words[i : i + shingle_words]), SEED) for i in some], "<u8")
        bits = np.unpackbits(digests.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(files: DataFrame, shingle_words: int = SHINGLE_WORDS, key: str | None = None) -> DataFrame:
    """file_id, row and fingerprint (its 64 bits as a signed long) of each row's whole text.

    `row` is the column `key`, or a number of its own for each row.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column("tag_text"), pa.binary()).to_pylist()
            found = np.array([fingerprint(text, shingle_words) for text in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pc.cast(batch.column("file_id"), pa.int64()), batch.column("row"), pa.array(found.view(np.int64))],
                names=["file_id", "row", "fingerprint"],
            )

    row = F.col(key).cast("bigint") if key else F.monotonically_increasing_id()
    rows = files.select("file_id", row.alias("row"), whole_text().alias("tag_text"))
    return rows.mapInArrow(work, "file_id bigint, row bigint, fingerprint bigint")


def near_duplicates(
    files: DataFrame, max_difference: int = MAX_DIFFERENCE, node_rows: int = NODE_ROWS, key: str | None = None
) -> DataFrame:
    """One row per row of `files` (file_id, tag_text): file_id, fingerprint, component_id, kept.

    The fingerprint is written as 16 lowercase hex digits. A-Z are lower-cased, words are runs
    without ASCII white space, shingles are four words with repeats; a shorter text is one
    shingle, a text without words has fingerprint zero and is linked like any other. Fingerprints
    that differ in at most `max_difference` bits are linked, and `component_id` is the smallest
    `file_id` that can be reached over links, the row's own included. One row of each component is
    `kept`: the one with that id. If `key` names a column of whole numbers, it is returned too.

    A null text counts as empty. A null `file_id` is never a component's id unless all its rows
    lack one; repeated rows share a component. An empty table gives an empty result and further
    columns are ignored. Rows with equal fingerprints are folded to one before anything is
    compared, so large groups of copies cost no more than one row; no pairs are listed.
    """
    rows = cut_lineage(fingerprints(files, key=key), "fingerprints")
    first = F.struct(F.col("file_id").isNull().alias("no_id"), "file_id", "row")
    distinct = cut_lineage(rows.groupBy("fingerprint").agg(F.min(first).alias("first")), "distinct-fingerprints")
    roots = components(links(distinct.select("fingerprint"), max_difference, node_rows))
    joined = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    # Tables that are joined are written first: a join of plain exchanges is split where a key is frequent.
    joined = cut_lineage(joined, "rooted-fingerprints")
    best = cut_lineage(joined.groupBy("root").agg(F.min("first").alias("best")), "components")
    classes = cut_lineage(joined.join(best, "root").select("fingerprint", "best"), "classes")
    return rows.join(classes, "fingerprint").select(
        "file_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("best.file_id").alias("component_id"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        *([F.col("row").alias(key)] if key else []),
    )


def stretches(max_difference: int) -> list[int]:
    """Lengths of the max_difference + 1 stretches that the bits are cut into."""
    n = max_difference + 1
    return [BITS * (k + 1) // n - BITS * k // n for k in range(n)]


def allowed(max_difference: int, start: int) -> list[int]:
    """By depth 0 to 64: differing bits allowed above it when the walk starts with a stretch."""
    lengths = stretches(max_difference)
    lengths = lengths[start:] + lengths[:start]
    return [0, *[j for j, length in enumerate(lengths) for _ in range(length)]]


def links(distinct: DataFrame, max_difference: int = MAX_DIFFERENCE, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links `a`, `b` between distinct fingerprints that connect all within `max_difference` bits.

    Only what connects them is listed: each walk names, for a fingerprint, one other fingerprint of
    its part that it is connected to by links.
    """
    lengths = stretches(max_difference)
    turned, at = [], 0
    for start, length in enumerate(lengths):
        value = F.col("fingerprint")
        if at:
            value = F.shiftleft(value, at).bitwiseOR(F.shiftrightunsigned(value, BITS - at))
        node = F.shiftrightunsigned(value, BITS - length)
        turned.append(
            F.struct(
                F.lit(start).alias("start"),
                F.lit(length).alias("depth"),
                node.alias("left"),
                node.alias("right"),
                F.lit(0).alias("differing"),
                F.lit(False).alias("on_right"),
                value.alias("key"),
            )
        )
        at += length
    pair = ["start", "depth", "left", "right", "differing"]
    rows = distinct.select(F.inline(F.array(*turned)))
    done = []
    # Each step leaves the node pairs that are still too large and walks them down further.
    while True:
        crowded = rows.groupBy(*pair).agg(F.count("*").alias("n")).where(F.col("n") > node_rows).drop("n")
        crowded = cut_lineage(crowded, "crowded-nodes")
        if crowded.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(crowded, pair, "left_anti"))
        rows = cut_lineage(_walk_down(rows.join(crowded, pair, "left_semi"), max_difference), "node-pairs")
    small = done[0]
    for more in done[1:]:
        small = small.unionByName(more)
    dealt = small.repartition(*pair).sortWithinPartitions(*pair)
    found = dealt.mapInPandas(lambda frames: _walk(frames, max_difference), "a bigint, b bigint")
    return found.distinct()


def _walk_down(rows: DataFrame, max_difference: int) -> DataFrame:
    """The children of node pairs, STEP bits further down; a row goes to every pair it may be in."""
    limits = F.array(*[F.array(*[F.lit(x) for x in allowed(max_difference, s)]) for s in range(max_difference + 1)])
    depth = F.least(F.col("depth") + STEP, F.lit(BITS))
    step = depth - F.col("depth")
    limit = F.get(F.get(limits, F.col("start")), depth)
    own = F.expr(f"shiftrightunsigned(key, {BITS} - least(depth + {STEP}, {BITS}))")
    masks = F.filter(
        F.array(*[F.lit(m).cast("bigint") for m in range(1 << STEP)]),
        lambda m: (F.bit_count(m) + F.col("differing") <= limit) & (m < F.expr(f"shiftleft(1, least({STEP}, {BITS} - depth))")),
    )
    flipped = (
        rows.withColumns({"_own": own, "_depth": depth, "_step": step})
        .select("*", F.explode(masks).alias("_mask"))
        .withColumn(
            "_other",
            F.expr("shiftleft(if(on_right, left, right), _step) | ((_own & (shiftleft(1L, _step) - 1)) ^ _mask)"),
        )
    )
    # Inside one node the two children are ordered by their path; between nodes sides stay.
    swap = F.when(F.col("left") == F.col("right"), F.col("_own") > F.col("_other")).otherwise(F.col("on_right"))
    walked = flipped.select(
        "start",
        F.col("_depth").alias("depth"),
        F.when(swap, F.col("_other")).otherwise(F.col("_own")).alias("left"),
        F.when(swap, F.col("_own")).otherwise(F.col("_other")).alias("right"),
        (F.col("differing") + F.bit_count("_mask")).cast("int").alias("differing"),
        swap.alias("on_right"),
        "key",
    )
    pair = ["start", "depth", "left", "right", "differing"]
    # A pair with rows on one side only has nothing to compare.
    both = walked.groupBy(*pair).agg(F.max("on_right").alias("_r"), F.min("on_right").alias("_l"))
    both = both.where("left = right or (_r and not _l)").select(*pair)
    return walked.join(both, pair, "left_semi")


def _walk(frames: Iterator[pd.DataFrame], max_difference: int) -> Iterator[pd.DataFrame]:
    """Walks whole node pairs; rows come sorted by pair, and a pair may lie across batches."""
    pair = ["start", "depth", "left", "right", "differing"]
    kept: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        kept.append(frame)
        rows = pd.concat(kept, ignore_index=True)
        last = (rows[pair] == rows[pair].iloc[-1]).all(axis=1)
        ready, rest = rows[~last], rows[last]
        kept = [rest]
        if len(ready):
            yield from _walk_pairs(ready, max_difference)
    if kept:
        yield from _walk_pairs(pd.concat(kept, ignore_index=True), max_difference)


def _walk_pairs(rows: pd.DataFrame, max_difference: int) -> Iterator[pd.DataFrame]:
    for (start, depth), some in rows.groupby(["start", "depth"], sort=False):
        turn = sum(stretches(max_difference)[:start])
        some = some.assign(key=some["key"].astype(np.int64).to_numpy().view(np.uint64))
        some = some.sort_values(["left", "right", "differing", "on_right", "key"], kind="stable")
        keys = some["key"].to_numpy()
        right = some["on_right"].to_numpy()
        change = (some[["left", "right", "differing"]].diff().fillna(1) != 0).any(axis=1).to_numpy()
        low = np.flatnonzero(change)
        high = np.append(low[1:], len(keys))
        lefts = np.add.reduceat((~right).astype(np.int64), low)
        inside = (some["left"] == some["right"]).to_numpy()[low]
        middle = np.where(inside, low, low + lefts)
        frontier = np.stack([low, np.where(inside, high, middle), middle, high, some["differing"].to_numpy()[low]])
        roots = walk(keys, frontier.astype(np.int64), int(depth), allowed(max_difference, int(start)), max_difference)
        linked = roots != np.arange(len(keys))
        if linked.any():
            back = lambda x: ((x >> np.uint64(turn)) | (x << np.uint64((BITS - turn) % BITS))) if turn else x
            a, b = back(keys[linked]), back(keys[roots[linked]])
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def walk(keys: np.ndarray, frontier: np.ndarray, depth: int, limits: list[int], most: int) -> np.ndarray:
    """Walks node pairs down the trie; for each place in `keys` the least place it is linked to.

    `keys` is sorted inside each node. A column of `frontier` is a pair of nodes, as places
    [low1, high1) and [low2, high2) (equal for a node with itself), and their differing bits. Node
    pairs whose fingerprints are all connected already are not walked on.
    """
    union = _Union(keys, most)
    stack = [(depth, frontier)]
    while stack:
        depth, pairs = stack.pop()
        pairs = pairs[:, ~union.connected(pairs)]
        if not pairs.shape[1]:
            continue
        size = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
        small = (size <= LEAF_PAIRS) | (depth >= BITS)
        for some in _chunks(pairs[:, small], size[small]):
            union.compare(*_places(some))
        pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        cross, self_ = _children(keys, pairs, depth, limits[depth + 1])
        # What lies inside nodes is walked first: it connects much of what lies between them.
        for part in (cross, self_):
            if part.shape[1]:
                stack.append((depth + 1, part))
    return union.roots()


def _children(keys: np.ndarray, pairs: np.ndarray, depth: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Child pairs between different nodes and of nodes with themselves, within the limit."""
    ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1))]).astype(np.int64)
    low1, high1, low2, high2, differing = pairs
    mid1 = high1 - (ones[high1] - ones[low1])
    mid2 = high2 - (ones[high2] - ones[low2])
    itself = (low1 == low2) & (high1 == high2)
    zero = np.stack([low1, mid1, low2, mid2, differing])
    one = np.stack([mid1, high1, mid2, high2, differing])
    mixed = np.stack([low1, mid1, mid2, high2, differing + 1])
    other = np.stack([mid1, high1, low2, mid2, differing + 1])[:, ~itself]
    cross = np.concatenate([zero[:, ~itself], one[:, ~itself], mixed, other], axis=1)
    self_ = np.concatenate([zero[:, itself], one[:, itself]], axis=1)
    alive = lambda p: p[:, (p[0] < p[1]) & (p[2] < p[3]) & (p[4] <= limit)]
    return alive(cross), alive(self_)


def _chunks(pairs: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Node pairs in groups of about CHUNK_PAIRS comparisons."""
    if not pairs.shape[1]:
        return
    group = np.cumsum(size) // CHUNK_PAIRS
    for cut in np.split(np.arange(pairs.shape[1]), np.flatnonzero(np.diff(group)) + 1):
        yield pairs[:, cut]


def _places(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places (i, j) of some node pairs; i < j inside a node."""
    low1, high1, low2, high2, _ = pairs
    wide, size = high2 - low2, (high1 - low1) * (high2 - low2)
    of = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    i, j = low1[of] + at // wide[of], low2[of] + at % wide[of]
    use = (low1[of] != low2[of]) | (i < j)
    return i[use], j[use]


class _Union:
    """Which places are connected, over runs of neighbours that are linked to begin with."""

    def __init__(self, keys: np.ndarray, most: int) -> None:
        self.keys, self.most = keys, most
        near = np.bitwise_count(keys[1:] ^ keys[:-1]) <= most
        self.run = np.concatenate([[0], np.cumsum(~near)]).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
        self.parent = np.arange(self.run[-1] + 1 if len(keys) else 0)

    def connected(self, pairs: np.ndarray) -> np.ndarray:
        low1, high1, low2, high2, _ = pairs
        first, last = self.run[low1], self.run[low2]
        one_run = (first == self.run[high1 - 1]) & (last == self.run[high2 - 1])
        return one_run & (self.parent[first] == self.parent[last])

    def compare(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.parent[self.run[i]], self.parent[self.run[j]]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        near = np.bitwise_count(self.keys[i] ^ self.keys[j]) <= self.most
        joined = np.unique(np.stack([a[near], b[near]], axis=1), axis=0)
        if not len(joined):
            return
        parent = self.parent.tolist()

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in joined.tolist():
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
        parent = np.array(parent)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        self.parent = parent

    def roots(self) -> np.ndarray:
        """For each place the least place connected to it."""
        first = np.searchsorted(self.run, np.arange(len(self.parent)))
        return first[self.parent[self.run]] if len(self.run) else self.run

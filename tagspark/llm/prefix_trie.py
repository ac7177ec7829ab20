"""The trie of event sequences that sessions share, from sorted sequences and their common prefixes.

Sessions are sorted by their sequences. What each has in common with the one before it is a list
of lengths, and a sparse table gives the least length between any two places. The sessions that
start with a prefix lie side by side, so each prefix finds the left and the right end of its members
by two binary searches of its own, without a stack that would have to walk the list in order.

Runs of sorted sequences are worked on by themselves. A prefix whose members reach over the end of
a run gives a part per run, and these are added up. Long sessions are cut into bands of
BAND_EVENTS events, whose first node stands for all that is before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tagspark.llm.texts import WORD
from tagspark.operators.ordered import range_totals
from tagspark.operators.skew import lookup_join
from tagspark.session import cut_lineage

# Bytes of the name of an event, of the SHA-256 of its type and text.
NAME_BYTES = 16
# Events of a session that lie in one row.
BAND_EVENTS = 512
# Bytes of ids that are joined into one row before they are digested in order.
ENDS_BYTES = 1 << 20
# Sequences of a run.
RUN_ROWS = 20_000


class SparseTable:
    """Least values of stretches of an array: one row per power of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least value in [low, high), which is not empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.rows[0].dtype)
        for k in np.unique(level).tolist():
            at = level == k
            row = self.rows[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out


def extents(common: np.ndarray, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last sequence that share their first `depth` events with sequence `at`.

    `common[i]` is what the sorted sequences i and i + 1 have in common.
    """
    if not len(common):
        return at, at
    table = SparseTable(common)
    low, high = np.zeros(len(at), np.int64), at.copy()  # the left end lies in [low, high]
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        mid = (low[open_] + high[open_]) >> 1
        fits = table.least(mid, at[open_]) >= depth[open_]
        high[open_] = np.where(fits, mid, high[open_])
        low[open_] = np.where(fits, low[open_], mid + 1)
    left = high
    low, high = at.copy(), np.full(len(at), len(common))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        mid = (low[open_] + high[open_] + 1) >> 1
        fits = table.least(at[open_], mid) >= depth[open_]
        low[open_] = np.where(fits, mid, low[open_])
        high[open_] = np.where(fits, high[open_], mid - 1)
    return left, low


# A node is named by its band, the two numbers of the band's first node, and a digest of its path there.
KEY = ["band", "s1", "s2", "path"]
_EMPTY = b""
_NODES = (
    "band bigint, s1 bigint, s2 bigint, path binary, depth bigint, parent_band bigint, parent_s1 bigint, parent_s2 bigint, parent_path binary, "
    "n bigint, smallest bigint, n_words bigint, place bigint, last_place bigint, is_whole boolean"
)


def _next(band: int, s1: int, s2: int, names: bytes) -> tuple[int, int, int]:
    """The band after a full one, and its first node's numbers: sums of digests of each band and its place."""
    digest = hashlib.sha256(b"%d:" % band + names).hexdigest()
    return band + 1, s1 + int(digest[:10], 16), s2 + int(digest[10:20], 16)


def _nodes_of_run(rows: pa.Table, place: int, band_events: int) -> pa.RecordBatch:
    """Nodes of a run of sorted sequences: members in the run, smallest session, first and last place."""
    band, s1, s2, n, smallest = (rows.column(c).to_numpy() for c in ("band", "s1", "s2", "n", "smallest"))
    paths, words = rows.column("names").to_pylist(), rows.column("words").to_pylist()
    length = np.array([len(p) // NAME_BYTES for p in paths])
    common = np.zeros(max(0, len(paths) - 1), np.int64)
    for i in np.flatnonzero((band[1:] == band[:-1]) & (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])).tolist():
        x, y = paths[i], paths[i + 1]
        low, high = 0, min(len(x), len(y)) // NAME_BYTES
        while low < high:
            mid = (low + high + 1) >> 1
            low, high = (mid, high) if x[: mid * NAME_BYTES] == y[: mid * NAME_BYTES] else (low, mid - 1)
        common[i] = low
    # Candidates: all prefixes of all sequences; those whose left end is their own are the nodes.
    at = np.repeat(np.arange(len(paths)), length)
    depth = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length) + 1
    left, right = extents(common, at, depth)
    own = left == at
    at, depth, right = at[own], depth[own], right[own]
    members = np.concatenate([[0], np.cumsum(n)])
    first = SparseTable(smallest).least(at, right + 1) if len(at) else np.zeros(0, np.int64)
    digests: list[bytes] = []
    keys: dict[str, list] = {c: [] for c in ("band", "s1", "s2", "path", "parent_band", "parent_s1", "parent_s2", "parent_path")}
    begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])).tolist() if len(at) else []
    for begin, end in zip(begins, [*begins[1:], len(at)], strict=True):
        i, from_ = int(at[begin]), int(depth[begin])
        path, here = paths[i], (int(band[i]), int(s1[i]), int(s2[i]))
        running = xxhash.xxh3_128(path[: (from_ - 1) * NAME_BYTES])
        before = (*here, running.digest() if from_ > 1 else _EMPTY)
        for d in range(from_, from_ + end - begin):
            running.update(path[(d - 1) * NAME_BYTES : d * NAME_BYTES])
            if d == band_events:
                node = (*_next(*here, path), _EMPTY)
            else:
                node = (*here, running.digest())
            for column, value in zip(keys, (*node, *before), strict=True):
                keys[column].append(value)
            before = node
    depths = band[at] * band_events + depth
    last_words = [words[i][d - 1] for i, d in zip(at.tolist(), depth.tolist(), strict=True)]
    columns = {
        **{c: pa.array(v, pa.binary() if c.endswith("path") else pa.int64()) for c, v in keys.items()},
        "depth": pa.array(depths, pa.int64()),
        "n": pa.array(members[right + 1] - members[at], pa.int64()),
        "smallest": pa.array(first, pa.int64()),
        "n_words": pa.array(last_words, pa.int64()),
        "place": pa.array(place + at, pa.int64()),
        "last_place": pa.array(place + right, pa.int64()),
        "is_whole": pa.array(depth == length[at], pa.bool_()),
    }
    names = [c.split()[0] for c in _NODES.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)


def _nodes(batches: Iterator[pa.RecordBatch], band_events: int) -> Iterator[pa.RecordBatch]:
    place = TaskContext.get().partitionId() << 40
    for batch in batches:
        for at in range(0, batch.num_rows, RUN_ROWS):
            rows = batch.slice(at, RUN_ROWS)
            yield _nodes_of_run(pa.Table.from_batches([rows]), place, band_events)
            place += rows.num_rows


def named_events(events: DataFrame) -> DataFrame:
    """session_id, at (from 0, along seq), name and words of each event; null type and text are empty."""
    kind, text = (F.coalesce(F.col(c), F.lit("")) for c in ("type", "text"))
    known = F.col("seq").isNotNull()
    rows = events.where(F.col("session_id").isNotNull()).select(
        F.col("session_id").cast("bigint").alias("session_id"),
        known.alias("_known"),
        F.coalesce(F.col("seq").cast("bigint"), F.lit(0)).alias("_seq"),
        F.unhex(F.substring(F.sha2(F.concat(F.length(kind).cast("string"), F.lit(":"), kind, text).cast("binary"), 256), 1, 2 * NAME_BYTES)).alias("name"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    counted = range_totals(rows, ["_known", "_seq", "name"], {"_upto": F.lit(1).cast("bigint")}, ["session_id"])
    return counted.select("session_id", (F.col("_upto") - 1).alias("at"), "name", "words")


def _bands(events: DataFrame, band_events: int) -> DataFrame:
    """Rows of up to `band_events` events, with the numbers of the node that each begins at."""
    band = F.expr(f"at div {band_events}")
    listed = F.sort_array(F.collect_list(F.struct("at", "name", "words")))
    rows = events.groupBy("session_id", band.alias("band")).agg(listed.alias("_e"))
    rows = rows.select(
        "session_id",
        "band",
        F.unhex(F.array_join(F.transform("_e", lambda e: F.hex(e["name"])), "")).alias("names"),
        F.transform("_e", lambda e: e["words"]).alias("words"),
    ).withColumn("digest", F.sha2(F.concat(F.concat("band", F.lit(":")).cast("binary"), "names"), 256))
    rows = cut_lineage(rows, "bands")
    step = [F.conv(F.substring("digest", 1 + 10 * k, 10), 16, 10).cast("bigint") for k in range(2)]
    # Only sessions of several bands have numbers to add up.
    long_ = rows.where("band > 0").select("session_id").distinct()
    several = rows.select("session_id", "band", step[0].alias("a"), step[1].alias("b")).join(long_, "session_id", "left_semi")
    upto = range_totals(several, ["band"], {"s1": F.col("a"), "s2": F.col("b")}, ["session_id"])
    start = upto.select("session_id", "band", (F.col("s1") - F.col("a")).alias("s1"), (F.col("s2") - F.col("b")).alias("s2"))
    return rows.join(start, ["session_id", "band"], "left").na.fill(0, ["s1", "s2"])


def prefix_trie(events: DataFrame, sessions: DataFrame | None = None, band_events: int = BAND_EVENTS) -> DataFrame:
    """The nodes of the trie of event sequences of `events` (session_id, seq, type, text).

    A session's sequence is its events along seq (null first; equal ones by the digest of type and
    text). `sessions` names further sessions by session_id, which may have no events. Each distinct prefix of sequences is a node, its members are the sessions that
    start with it, and the root (depth 0) has all of them. Returns session_id (the smallest member),
    depth, parent_session_id (the smallest member of the parent; null for the root), n_sessions,
    n_children, n_leaves (childless nodes in the subtree, the node itself included), saved_words (for
    all nodes of the subtree, their members but one times the words of their last text), n_ends
    and ends_sha256 (of the ids, ascending and joined by commas, of members that end at the node).

    Null type and text are empty; rows and sessions with a null session_id belong to no session.
    Repeated events count each. No sessions give no nodes; further columns are ignored. Sequences
    are told apart by 128 bits of digests. What a task holds is a run of RUN_ROWS rows of at most
    `band_events` names; the ids that end at one node are digested in order by one task, from
    strings of ENDS_BYTES joined before.
    """
    named = named_events(events)
    bands = cut_lineage(_bands(named, band_events), "session-bands")
    all_ids = events.select("session_id")
    if sessions is not None:
        all_ids = all_ids.unionByName(sessions.select("session_id"))
    ids = cut_lineage(all_ids.select(F.col("session_id").cast("bigint").alias("session_id")).where("session_id IS NOT NULL").distinct(), "sessions")

    # Equal sequences are one row, so that a common one is no hot key.
    folded = bands.groupBy("band", "s1", "s2", "names").agg(
        F.count("*").alias("n"), F.min("session_id").alias("smallest"), F.first("words").alias("words")
    )
    order = ["band", "s1", "s2", "names"]
    parts = folded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _nodes(b, band_events), _NODES)
    parts = cut_lineage(parts, "node-parts")
    first = [F.first(c).alias(c) for c in ("depth", "parent_band", "parent_s1", "parent_s2", "parent_path", "n_words")]
    nodes = parts.groupBy(*KEY).agg(
        *first,
        F.sum("n").alias("n"),
        F.min("smallest").alias("smallest"),
        F.min("place").alias("place"),
        F.max("last_place").alias("last_place"),
        F.min_by("is_whole", "place").alias("is_whole"),
    )
    root = ids.agg(F.count("*").alias("n"), F.min("session_id").alias("smallest")).where("n > 0").select(
        *[F.lit(0).cast("bigint").alias(c) for c in ("band", "s1", "s2")],
        F.lit(_EMPTY).alias("path"),
        F.lit(0).cast("bigint").alias("depth"),
        *[F.lit(None).cast("bigint").alias(f"parent_{c}") for c in ("band", "s1", "s2")],
        F.lit(None).cast("binary").alias("parent_path"),
        F.lit(0).cast("bigint").alias("n_words"),
        "n",
        "smallest",
        F.lit(-1).cast("bigint").alias("place"),
        F.lit(None).cast("bigint").alias("last_place"),
        F.lit(False).alias("is_whole"),
    )
    nodes = cut_lineage(nodes.unionByName(root).withColumn("id", _id("")).withColumn("parent", _id("parent_")), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    valued = nodes.join(children, "id", "left").na.fill(0, ["n_children"])
    leaf = (F.col("n_children") == 0).cast("bigint")
    valued = valued.withColumns({"leaf": leaf, "saved": (F.col("n") - 1) * F.col("n_words")})
    valued = cut_lineage(valued, "valued-nodes")

    totals = _subtrees(valued, bands, band_events)
    ends = _ends(bands, ids, band_events)
    parents = cut_lineage(valued.select(F.col("id").alias("parent"), F.col("smallest").alias("parent_session_id")), "parents")
    found = lookup_join(valued.drop("leaf", "saved"), parents, "parent", "id")
    found = found.join(totals, "id").join(ends, "id", "left")
    return found.select(
        F.col("smallest").alias("session_id"),
        "depth",
        "parent_session_id",
        F.col("n").alias("n_sessions"),
        "n_children",
        "n_leaves",
        F.col("saved_words"),
        F.coalesce("n_ends", F.lit(0).cast("bigint")).alias("n_ends"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def _id(prefix: str) -> Column:
    band, s1, s2, path = (F.col(prefix + c) for c in KEY)
    return F.when(band.isNotNull(), F.concat_ws(".", band, s1, s2, F.hex(path)))


def _subtrees(nodes: DataFrame, bands: DataFrame, band_events: int) -> DataFrame:
    """id, n_leaves and saved_words over each node's subtree.

    In the order of places and depths a node's subtree inside its band stands without a gap, so its
    sums are differences of running totals. What hangs below a band's end is added at its end
    node: each later node is counted for its smallest session, whose sums go up its own bands.
    """
    values = ["leaf", "saved"]
    full = F.col("depth") % band_events == 0
    own_band = F.expr(f"(depth - 1) div {band_events}")
    inner = nodes.where("depth > 0").withColumn("own_band", own_band)
    later = inner.where("own_band > 0").groupBy(F.col("smallest").alias("session_id"), F.col("own_band").alias("band"))
    later = later.agg(*[F.sum(v).alias(v) for v in values])
    several = bands.where("band > 0").select("session_id", "band", "s1", "s2").join(later, ["session_id", "band"], "left").na.fill(0, values)
    summed = range_totals(several.withColumn("back", -F.col("band")), ["back"], {f"up_{v}": F.col(v) for v in values}, ["session_id"])
    hanging = summed.groupBy("band", "s1", "s2").agg(*[F.sum(f"up_{v}").alias(f"below_{v}") for v in values])
    hanging = hanging.select(F.concat_ws(".", "band", "s1", "s2", F.lit("")).alias("id"), *[f"below_{v}" for v in values])
    inner = inner.join(hanging, "id", "left").na.fill(0, [f"below_{v}" for v in values])
    inner = inner.select("id", "depth", "place", "last_place", "is_whole", *[(F.col(v) + F.when(full, F.col(f"below_{v}")).otherwise(0)).alias(v) for v in values])
    along = cut_lineage(range_totals(inner, ["place", "depth"], {f"upto_{v}": F.col(v) for v in values}), "totals-along")
    last = along.where("is_whole").select(F.col("place").alias("last_place"), *[F.col(f"upto_{v}").alias(f"end_{v}") for v in values])
    sums = [(F.col(f"end_{v}") - F.col(f"upto_{v}") + F.col(v)).alias(name) for v, name in zip(values, ("n_leaves", "saved_words"), strict=True)]
    found = along.drop("is_whole").join(last, "last_place").select("id", *sums)
    root = nodes.agg(F.min_by("id", "depth").alias("id"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_words"))
    return found.unionByName(root.where("id IS NOT NULL"))


def _ends(bands: DataFrame, ids: DataFrame, band_events: int) -> DataFrame:
    """id, n_ends and ends_sha256 of the nodes where sessions end."""
    last = bands.groupBy("session_id").agg(F.max("band").alias("band"))
    closing = bands.join(last, ["session_id", "band"])

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for band, s1, s2, names in zip(*[batch.column(c).to_pylist() for c in ("band", "s1", "s2", "names")], strict=True):
                if len(names) == band_events * NAME_BYTES:
                    out.append("{}.{}.{}.".format(*_next(band, s1, s2, names)))
                else:
                    out.append(f"{band}.{s1}.{s2}.{xxhash.xxh3_128_hexdigest(names).upper()}")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column("session_id")], names=["id", "session_id"])

    ending = closing.select("band", "s1", "s2", "names", "session_id").mapInArrow(closed, "id string, session_id bigint")
    eventless = ids.join(last.select("session_id"), "session_id", "left_anti").select(F.lit("0.0.0.").alias("id"), "session_id")
    dealt = ending.unionByName(eventless).repartitionByRange("id", "session_id").sortWithinPartitions("id", "session_id")
    joined = cut_lineage(dealt.mapInArrow(_joined_ids, "id string, first bigint, n bigint, listed binary"), "joined-ids")
    ordered = joined.repartition("id").sortWithinPartitions("id", "first")
    return ordered.mapInArrow(_digested_ids, "id string, n_ends bigint, ends_sha256 string")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids that end at one node, in order, joined into strings of bounded size."""
    id_: str | None = None
    held: list[bytes] = []
    first = size = 0

    def row() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        values = (id_, first, len(held), b",".join(held))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["id", "first", "n", "listed"])

    for batch in batches:
        for node, session in zip(batch.column("id").to_pylist(), batch.column("session_id").to_pylist(), strict=True):
            if held and (node != id_ or size > ENDS_BYTES):
                yield row()
                held, size = [], 0
            if not held:
                id_, first = node, session
            held.append(b"%d" % session)
            size += len(held[-1]) + 1
    if held:
        yield row()


def _digested_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node over its strings, which come in order."""
    id_: str | None = None
    digest, n = hashlib.sha256(), 0
    names = ["id", "n_ends", "ends_sha256"]
    for batch in batches:
        out = []
        for node, more, listed in zip(*[batch.column(c).to_pylist() for c in ("id", "n", "listed")], strict=True):
            if node != id_:
                if id_ is not None:
                    out.append((id_, n, digest.hexdigest()))
                id_, n, digest = node, 0, hashlib.sha256()
            elif n:
                digest.update(b",")
            digest.update(listed)
            n += more
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
    if id_ is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (id_, n, digest.hexdigest())], names=names)

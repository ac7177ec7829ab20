"""How the words of each tag service differ from those of the others, by chunk factorization.

Texts are cut at white space into chunks, counted per file. Each chunk is cut into terms once,
however many files hold it, and its terms are joined back to its counts. So the work on characters
grows with the distinct chunks, and what is shuffled with the distinct chunks of a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tagspark.session import cut_lineage

MIN_FILES = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
# Words that a task sorts at a time, and counts that it holds before it hands them on.
SORT_WORDS = 1 << 20
HELD_COUNTS = 1 << 21

_COUNTED = "chunk string, mime_id bigint, seen array<bigint>, groups array<bigint>, counts array<bigint>"
_TERMS = "term string, mime_id bigint, seen array<bigint>, groups array<bigint>, counts array<bigint>"
_KEPT = "term string, mime_id bigint, groups array<bigint>, counts array<bigint>"


class _Numbers(dict):
    """Numbers things as they come."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _ranks(starts: np.ndarray, n: int) -> np.ndarray:
    """Place of each of n sorted rows in its group."""
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


class _ChunkCounts:
    """Counts of chunks by group, and of each chunk and mime type the first rows that hold it."""

    def __init__(self, min_files: int) -> None:
        self.min_files = min_files
        self.chunks, self.groups = _Numbers(), _Numbers()
        self.counts: list[np.ndarray] = []
        self.seen: list[np.ndarray] = []
        self.words: list[np.ndarray] = []
        self.docs: list[tuple[int, int]] = []
        self.n_words = self.n_held = 0

    def add(self, text: bytes, group: tuple[int, int], row: int) -> None:
        words = text.split()
        if words:
            self.words.append(np.fromiter(map(self.chunks.__getitem__, words), np.int64, len(words)))
            self.docs.append((self.groups[group], row))
            self.n_words += len(words)
            if self.n_words >= SORT_WORDS:
                self._count()

    def _mimes(self) -> np.ndarray:
        numbers = _Numbers()
        return np.array([numbers[m] for m, _ in self.groups], np.int64)

    def _count(self) -> None:
        """Chunks of each row once, with their count, then by group."""
        if not self.words:
            return
        sizes = [len(w) for w in self.words]
        code = np.repeat(np.arange(len(sizes)), sizes) << 40 | np.concatenate(self.words)
        code, n = np.unique(code, return_counts=True)
        doc, chunk = code >> 40, code & (1 << 40) - 1
        group, row = np.array(self.docs, np.int64)[doc].T
        mime = self._mimes()[group]
        by = np.argsort(chunk * len(self.groups) + mime, kind="stable")  # rows stay in order
        first = _ranks(_heads(chunk[by], mime[by]), len(by)) < self.min_files
        self.seen.append(np.stack([chunk[by], mime[by], row[by]])[:, first])
        by = np.argsort(chunk * len(self.groups) + group)
        starts = _heads(chunk[by], group[by])
        self.counts.append(np.stack([chunk[by][starts], group[by][starts], np.add.reduceat(n[by], starts)]))
        self.n_held += self.counts[-1].shape[1]
        self.words, self.docs, self.n_words = [], [], 0

    def take(self) -> pa.RecordBatch:
        """One row for each chunk and mime type; nothing is held after that."""
        self._count()
        empty = [np.zeros((3, 0), np.int64)]
        chunk, group, n = np.concatenate(empty + self.counts, axis=1)
        mime = self._mimes()[group]
        wide = max(1, len(self.groups))
        by = np.argsort((chunk * wide + mime) * wide + group)
        chunk, mime, group, n = chunk[by], mime[by], group[by], n[by]
        starts = _heads(chunk, mime, group)
        n = np.add.reduceat(n, starts) if len(n) else n
        chunk, mime, group = chunk[starts], mime[starts], group[starts]
        rows = _heads(chunk, mime)
        held, of, row = np.concatenate(empty + self.seen, axis=1)
        by = np.argsort(held * wide + of, kind="stable")
        held, of, row = held[by], of[by], row[by]
        starts = _heads(held, of)
        first = _ranks(starts, len(by)) < self.min_files
        sizes = np.minimum(np.diff(np.append(starts, len(by))), self.min_files)
        ids = np.array(list(self.groups), np.int64).reshape(-1, 2)
        names = pa.array(list(self.chunks), pa.binary()).take(pa.array(chunk[rows])).cast(pa.string())
        ends = pa.array(np.append(rows, len(chunk)), pa.int32())
        columns = [
            names,
            pa.array(ids[group[rows], 0]),
            pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(row[first])),
            pa.ListArray.from_arrays(ends, pa.array(ids[group, 1])),
            pa.ListArray.from_arrays(ends, pa.array(n)),
        ]
        self.__init__(self.min_files)
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "mime_id", "seen", "groups", "counts"])


def _count_chunks(batches: Iterator[pa.RecordBatch], min_files: int) -> Iterator[pa.RecordBatch]:
    """Chunks of a task's rows (mime_id, group_id, tag_text) with their counts by group."""
    row = TaskContext.get().partitionId() << 40
    held = _ChunkCounts(min_files)
    for batch in batches:
        groups = zip(batch.column("mime_id").to_pylist(), batch.column("group_id").to_pylist(), strict=True)
        for group, text in zip(groups, pc.cast(batch.column("tag_text"), pa.binary()).to_pylist(), strict=True):
            held.add(text, group, row)
            row += 1
            if held.n_held >= HELD_COUNTS:
                yield held.take()
    yield held.take()


def _merge(rows: pa.Table, key: str, min_files: int) -> pa.Table:
    """Rows sorted by a key and mime type, one for each of both: sums by group, and the first rows seen."""
    name, mime = rows.column(key).combine_chunks(), rows.column("mime_id").to_numpy()
    starts = _heads(name.dictionary_encode().indices.to_numpy(), mime)
    place = np.cumsum(np.isin(np.arange(len(mime)), starts)) - 1

    def flat(column: str) -> tuple[np.ndarray, np.ndarray]:
        lists = rows.column(column).combine_chunks()
        return np.repeat(place, lists.value_lengths().to_numpy()), lists.flatten().to_numpy()

    def lists(at: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(at, minlength=len(starts)))), pa.int32()), pa.array(values))

    at, group = flat("groups")
    n = flat("counts")[1]
    by = np.lexsort((group, at))
    heads = _heads(at[by], group[by])
    sums = np.add.reduceat(n[by], heads) if len(by) else n
    seen_at, seen = flat("seen")
    order = np.lexsort((seen, seen_at))
    seen_at, seen = seen_at[order], seen[order]
    once = _heads(seen_at, seen)
    seen_at, seen = seen_at[once], seen[once]
    first = _ranks(_heads(seen_at), len(seen)) < min_files if len(seen) else np.zeros(0, bool)
    return pa.table(
        {
            key: name.take(pa.array(starts)),
            "mime_id": pa.array(mime[starts]),
            "seen": lists(seen_at[first], seen[first]),
            "groups": lists(at[by][heads], group[by][heads]),
            "counts": lists(at[by][heads], sums),
        }
    )


def _merged(batches: Iterator[pa.RecordBatch], key: str, min_files: int) -> Iterator[pa.Table]:
    """Merged rows of a sorted partition; only the last key is held from batch to batch."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch]).select([key, "mime_id", "seen", "groups", "counts"])
        merged = _merge(new if held is None else pa.concat_tables([held, new.cast(held.schema)]), key, min_files)
        if merged.num_rows > 1:
            yield merged.slice(0, merged.num_rows - 1)
        held = merged.slice(merged.num_rows - 1)
    if held is not None:
        yield held


# Bytes that are no part of a term become spaces, A-Z become small.
_TERM_BYTES = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(chunk: bytes) -> list[bytes]:
    """Runs of ASCII letters, in small letters, and all characters beyond ASCII."""
    return chunk.translate(_TERM_BYTES).split()


def _tokenize(batches: Iterator[pa.RecordBatch], min_files: int) -> Iterator[pa.RecordBatch]:
    """Each distinct chunk of a partition sorted by chunk is cut once; its terms join its merged counts."""
    last: tuple[bytes, list[bytes]] = (b"", [])
    for rows in _merged(batches, "chunk", min_files):
        codes = rows.column("chunk").combine_chunks().cast(pa.binary()).dictionary_encode()
        distinct = codes.dictionary.to_pylist()
        found = [last[1] if chunk == last[0] else terms_of(chunk) for chunk in distinct]
        last = distinct[-1], found[-1]
        sizes = np.array([len(f) for f in found])[codes.indices.to_numpy()]
        index = pa.array(np.repeat(np.arange(rows.num_rows), sizes))
        terms = pa.array([t for code in codes.indices.to_pylist() for t in found[code]], pa.binary()).cast(pa.string())
        columns = [terms, *[rows.column(c).take(index).combine_chunks() for c in ("mime_id", "seen", "groups", "counts")]]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "mime_id", "seen", "groups", "counts"])


def _keep(batches: Iterator[pa.RecordBatch], min_files: int) -> Iterator[pa.RecordBatch]:
    """Terms that enough rows hold."""
    for rows in _merged(batches, "term", min_files):
        kept = rows.filter(pc.greater_equal(pc.list_value_length(rows.column("seen")), min_files))
        yield from kept.select(["term", "mime_id", "groups", "counts"]).combine_chunks().to_batches()


def share_of(n: Column, total: Column, vocabulary: Column) -> Column:
    """Share of a term in parts of SCALE, with one occurrence added to each term; exact."""
    scaled = F.lit(SCALE).cast("decimal(19,0)") * (n + 1).cast("decimal(19,0)")
    return F.call_function("div", scaled, F.greatest(total + vocabulary, F.lit(1)).cast("decimal(19,0)")).cast("bigint") + 1


def distance(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / q) of whole numbers, at least 0."""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over terms of what two services that both have a term add to their distance.

    Rows (mime, term, service_key, p, absent) come sorted by mime and term. `absent` is the share
    of a term that the service does not have; sums without both sides have been counted with it.
    """
    sums: Counter[tuple[str, str, str]] = Counter()
    held: pa.Table | None = None

    def add(rows: pa.Table) -> None:
        codes = rows.column("service_key").combine_chunks().dictionary_encode()
        key, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
        mimes = rows.column("mime").combine_chunks().dictionary_encode()
        mime, mime_names = mimes.indices.to_numpy(), mimes.dictionary.to_pylist()
        term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        p, absent = (rows.column(c).to_numpy() for c in ("p", "absent"))
        starts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (mime[1:] != mime[:-1])]))
        sizes = np.diff(np.append(starts, len(term)))
        # A term's row meets the k-th next one of its term, for k = 1, 2, ...: no list of pairs.
        left = np.repeat(starts + sizes, sizes) - np.arange(len(term))
        found = []
        for k in range(1, int(sizes.max())):
            i = np.flatnonzero(left > k)
            for a, b in ((i, i + k), (i + k, i)):
                value = _distance(p[a], p[b]) - _distance(p[a], absent[b]) - _distance(absent[a], p[b]) + _distance(absent[a], absent[b])
                pair, at = np.unique((mime[a].astype(np.int64) * len(names) + key[a]) * len(names) + key[b], return_inverse=True)
                total = np.zeros(len(pair), np.int64)
                np.add.at(total, at, value)
                found += zip(pair.tolist(), total.tolist(), strict=True)
        for pair, total in found:
            first, b = divmod(pair, len(names))
            m, a = divmod(first, len(names))
            sums[mime_names[m], names[a], names[b]] += total

    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        # The last term may go on in the next batch.
        last = [held.column(c)[-1] for c in ("mime", "term")]
        same = pc.and_(pc.equal(held.column("mime"), last[0]), pc.equal(held.column("term"), last[1]))
        whole = held.num_rows - pc.sum(same).as_py()
        if whole:
            add(held.slice(0, whole))
            held = held.slice(whole)
    if held is not None:
        add(held)
    rows = [(*pair, total) for pair, total in sums.items()]
    kinds = (("mime", pa.string()), ("service_key", pa.string()), ("item", pa.string()), ("value", pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])


def term_counts(files: DataFrame, min_files: int = MIN_FILES) -> tuple[DataFrame, DataFrame]:
    """Counts (mime, service_key, term, n) of kept terms, and all groups (mime, service_key) with total and vocabulary.

    A mime type keeps the terms in at least `min_files` of its rows. Which rows hold a chunk is
    known up to `min_files` of them, which decides that exactly. Mime types and groups go by 64 bits
    of a digest until their names are joined back. Both tables are written.
    """
    plain = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("mime", "service_key", "tag_text")]
    ids = [F.xxhash64("mime").alias("mime_id"), F.xxhash64("mime", "service_key").alias("group_id")]
    rows = files.select(*plain).select(*ids, "tag_text").mapInArrow(lambda b: _count_chunks(b, min_files), _COUNTED)
    chunks = rows.repartition("chunk").sortWithinPartitions("chunk", "mime_id")
    found = chunks.mapInArrow(lambda b: _tokenize(b, min_files), _TERMS)
    dealt = found.repartition("mime_id", "term").sortWithinPartitions("term", "mime_id")
    kept = cut_lineage(dealt.mapInArrow(lambda b: _keep(b, min_files), _KEPT), "kept-terms")
    counts = kept.select("mime_id", "term", F.explode(F.arrays_zip("groups", "counts")).alias("g"))
    counts = counts.select("mime_id", "term", F.col("g.groups").alias("group_id"), F.col("g.counts").alias("n"))
    named = files.select(*plain[:2]).distinct().select("*", *ids)
    named = cut_lineage(named, "named-groups")
    counts = counts.drop("mime_id").join(named.drop("mime_id"), "group_id")
    counts = cut_lineage(counts.select("mime", "service_key", "term", "n"), "term-counts")
    vocabulary = counts.groupBy("mime").agg(F.countDistinct("term").alias("vocabulary"))
    totals = counts.groupBy("mime", "service_key").agg(F.sum("n").alias("total"))
    groups = named.drop("mime_id", "group_id").join(totals, ["mime", "service_key"], "left").join(vocabulary, "mime", "left")
    return counts, cut_lineage(groups.na.fill(0, ["total", "vocabulary"]), "groups")


def source_divergence(files: DataFrame, min_files: int = MIN_FILES, top: int = TOP_TERMS) -> DataFrame:
    """How much the terms of each service differ, among the files of each mime type.

    `files` has file_id, mime, service_key and tag_text, one row per file and service; a group is a
    mime type and a service that occur together, also without any term. A term's share p in a group
    is 1 + floor(SCALE * (n + 1) / (total + vocabulary)), with n its occurrences there, and its
    distance from a share q is floor((p - q)^2 / q); all arithmetic is exact. Returns mime,
    service_key, part, item, value, rank (from 1, by descending value, then by item as UTF-8):

    * part `pair`: item is each other service of the mime type; the value sums the distances from
      that service's shares over all kept terms, whether or not the two have them;
    * part `term`: item is a kept term of the group whose share is above that of the whole mime
      type, the value its distance from it; ranks up to `top`.

    Null mime, service_key and tag_text are empty strings, and a group of empty names is a group
    like any other. Repeated rows count as rows of their own. An empty table gives no rows, further
    columns are ignored.
    """
    counts, groups = term_counts(files, min_files)
    one = groups.select(
        "mime", "service_key", "total", "vocabulary", share_of(F.lit(0).cast("bigint"), F.col("total"), F.col("vocabulary")).alias("absent")
    )
    shared = counts.join(one, ["mime", "service_key"]).withColumn("p", share_of(F.col("n"), F.col("total"), F.col("vocabulary")))
    shared = cut_lineage(shared.select("mime", "service_key", "term", "n", "p", "absent"), "shares")

    # As if no service had a term, then what each side's own terms change, then those of both.
    other = one.select("mime", F.col("service_key").alias("item"), F.col("absent").alias("item_absent"))
    apart = F.col("service_key") != F.col("item")
    none = one.join(other, "mime").where(apart).select(
        "mime", "service_key", "item", (F.col("vocabulary") * distance("absent", "item_absent")).alias("value")
    )
    alike = shared.groupBy("mime", "service_key", "p", "absent").agg(F.count("*").alias("m"))
    met = alike.join(other, "mime").where(apart)
    own = met.select(
        "mime", "service_key", "item", (F.col("m") * (distance("p", "item_absent") - distance("absent", "item_absent"))).alias("value")
    )
    theirs = met.select(
        "mime",
        F.col("item").alias("service_key"),
        F.col("service_key").alias("item"),
        (F.col("m") * (distance("item_absent", "p") - distance("item_absent", "absent"))).alias("value"),
    )
    dealt = shared.select("mime", "term", "service_key", "p", "absent").repartition("mime", "term").sortWithinPartitions("mime", "term")
    both = dealt.mapInArrow(_pair_sums, "mime string, service_key string, item string, value bigint")
    pairs = none.unionByName(own).unionByName(theirs).unionByName(both)
    pairs = pairs.groupBy("mime", "service_key", "item").agg(F.sum("value").alias("value"))

    whole = shared.groupBy("mime", "term").agg(F.sum("n").alias("all"))
    sizes = groups.groupBy("mime").agg(F.sum("total").alias("total"), F.max("vocabulary").alias("vocabulary"))
    whole = whole.join(sizes, "mime").select("mime", "term", share_of(F.col("all"), F.col("total"), F.col("vocabulary")).alias("q"))
    terms = shared.join(whole, ["mime", "term"]).where("p > q").select(
        "mime", "service_key", F.col("term").alias("item"), distance("p", "q").alias("value")
    )

    along = Window.partitionBy("mime", "service_key").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(along).alias("rank")
    columns = ["mime", "service_key", "part", "item", "value", rank]
    ranked_pairs = pairs.withColumn("part", F.lit("pair")).select(*columns)
    ranked_terms = terms.withColumn("part", F.lit("term")).select(*columns).where(F.col("rank") <= top)
    return ranked_pairs.unionByName(ranked_terms)

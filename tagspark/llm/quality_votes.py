"""Quality of tag texts by the votes of their nearest neighbours in a latent-semantic space.

Texts are bags of hashed terms: their words and the shapes of their words. A truncated singular
value decomposition of a bounded sample of marked files gives the space. Every text is compared
with every vector of the sample, in blocks, and the marks of the nearest ones are averaged with
their cosines as weights.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tagspark.llm.texts import whole_text
from tagspark.session import cut_lineage

# Marked files in the sample, per mark: what is broadcast does not grow with the library.
SAMPLE_PER_MARK = 1_500
TERMS = 8_192
DIMENSIONS = 64
NEIGHBOURS = 25
# Texts whose cosines are computed at once.
BLOCK_TEXTS = 512
# A vote weighs the cosine to this power, so near neighbours outweigh many distant ones.
SHARPNESS = 4
HELD_OUT_FOLD = 1
FOLDS = 3
REMEMBERED = 200_000

_UPPER, _LOWER, _DIGIT = b"A", b"a", b"0"
_SHAPE = bytes.maketrans(
    bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(48, 58)) + bytes(range(128, 256)),
    _UPPER * 26 + _LOWER * 26 + _DIGIT * 10 + _LOWER * 128,
)
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


def held_out(file_id: str = "file_id") -> Column:
    """Whether a file's mark is never learned from; a file without an id is not held out."""
    fold = F.crc32(F.col(file_id).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(False))


class _Terms(dict):
    """Word -> places of its two terms: the word in lower case, and its shape."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        shape = _RUN.sub(rb"\1", word.translate(_SHAPE))
        places = zlib.crc32(word.lower()) % TERMS, zlib.crc32(b"\x00" + shape) % TERMS
        if len(self) < REMEMBERED:
            self[word] = places
        return places


_terms = _Terms()


def text_terms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and damped counts of the terms of a UTF-8 text, and of how varied its words are."""
    words = Counter(text.split())
    total = words.total()
    variety = b"\x01empty" if not total else b"\x01%d" % (10 * len(words) // total)
    counts: dict[int, int] = {zlib.crc32(variety) % TERMS: max(1, total)}
    for word, n in words.items():
        for place in _terms[word]:
            counts[place] = counts.get(place, 0) + n
    return np.fromiter(counts, np.int64, len(counts)), np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))


@dataclass(frozen=True)
class Neighbourhood:
    """The fitted space: `basis` maps terms to it, `vectors` are the marked files in it."""

    basis: np.ndarray
    vectors: np.ndarray
    marks: np.ndarray
    weights: np.ndarray
    prior: float

    def place(self, texts: list[bytes]) -> np.ndarray:
        """Unit vectors of some texts; zero where no term says anything."""
        found = np.zeros((len(texts), self.basis.shape[1]), np.float32)
        for row, text in enumerate(texts):
            places, values = text_terms(text)
            found[row] = values @ self.basis[places]
        return _unit(found)

    def votes(self, placed: np.ndarray) -> np.ndarray:
        """Share of the weighted votes of the nearest marked files that are for the mark."""
        if not len(self.vectors):
            return np.full(len(placed), self.prior)
        cosines = placed @ self.vectors.T
        k = min(NEIGHBOURS, len(self.vectors))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        power = np.clip(np.take_along_axis(cosines, near, axis=1), 0, 1).astype(np.float64) ** SHARPNESS
        weight = power * self.weights[near]
        total = weight.sum(axis=1)
        voted = (weight * self.marks[near]).sum(axis=1)
        return np.where(total > 0, voted / np.where(total > 0, total, 1), self.prior)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(length > 0, length, 1)).astype(np.float32)


def fit_neighbourhood(
    files: DataFrame, marks: DataFrame, sample_per_mark: int = SAMPLE_PER_MARK, dimensions: int = DIMENSIONS
) -> Neighbourhood:
    """Learn the space from marked files that are not held out.

    `marks` has file_id and archived (1: the curator archived it as good, 0: not). At most
    `sample_per_mark` files of each mark are used, chosen by a hash of their id, and only their
    hashed terms come to the driver. Null ids and marks are left out; of contradicting marks of
    one file the lower counts. Votes are weighted so that both marks count as in all marks.
    """
    known = marks.where(F.col("file_id").isNotNull() & F.col("archived").isNotNull() & ~held_out())
    one = known.groupBy("file_id").agg((F.min("archived") > 0).cast("int").alias("archived"))
    one = cut_lineage(one, "marks")
    sizes = {r["archived"]: r["count"] for r in one.groupBy("archived").count().collect()}
    by_hash = [F.xxhash64("file_id"), F.col("file_id")]
    picked = [one.where(F.col("archived") == mark).orderBy(*by_hash).limit(sample_per_mark) for mark in (0, 1)]
    sample = picked[0].unionByName(picked[1])
    # At most two small limits of rows: a bounded broadcast.
    texts = files.select("file_id", whole_text().alias("tag_text")).join(F.broadcast(sample), "file_id")
    rows = texts.mapInArrow(_sample_terms, "file_id bigint, archived int, places array<bigint>, amounts array<float>")
    found = rows.toArrow().sort_by([("file_id", "ascending"), ("archived", "ascending")])
    n = found.num_rows
    mark = np.array(found.column("archived").to_pylist(), np.int64)
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if not n:
        empty = np.zeros((0, dimensions), np.float32)
        return Neighbourhood(np.zeros((TERMS, dimensions), np.float32), empty, mark, np.zeros(0), prior)
    counts = np.zeros((n, TERMS), np.float32)
    for row, (places, amounts) in enumerate(zip(found.column("places"), found.column("amounts"), strict=True)):
        counts[row, places.values.to_numpy()] = amounts.values.to_numpy()
    rarity = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    weighted = _unit(counts * rarity)
    # Randomized range finder, two power steps.
    drawn = np.random.default_rng(0).standard_normal((TERMS, dimensions + 16)).astype(np.float32)
    range_ = np.linalg.qr(weighted @ drawn)[0]
    for _ in range(2):
        range_ = np.linalg.qr(weighted @ (weighted.T @ range_))[0]
    _, _, axes = np.linalg.svd(range_.T @ weighted, full_matrices=False)
    basis = np.zeros((TERMS, dimensions), np.float32)
    axes = axes[:dimensions].T
    basis[:, : axes.shape[1]] = rarity[:, None] * axes
    share = {m: sizes.get(m, 0) / max(1, int((mark == m).sum())) for m in (0, 1)}
    weights = np.where(mark == 1, share[1], share[0])
    return Neighbourhood(basis, _unit(counts @ basis), mark, weights, prior)


def quality_votes(
    files: DataFrame, marks: DataFrame, sample_per_mark: int = SAMPLE_PER_MARK, dimensions: int = DIMENSIONS
) -> DataFrame:
    """file_id, held_out, score and predicted for every row of `files` (file_id, tag_text).

    `score` (0 to 1) is the likelihood of the mark `archived` by the votes; only the whole text
    speaks, never the id or the service. `predicted` is 1 from a score of 0.5 on. Marks of held
    out files are not learned from.

    A null text counts as empty. A text near to no marked file, such as any text when there are no
    marks, scores the share of archived files among the marks (0 without marks). Null ids and
    repeated rows are scored like others; further columns are ignored; an empty table gives no
    rows.
    """
    fitted = files.sparkSession.sparkContext.broadcast(fit_neighbourhood(files, marks, sample_per_mark, dimensions))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = fitted.value
        for batch in batches:
            texts = pc.cast(batch.column("tag_text"), pa.binary()).to_pylist()
            blocks = [near.votes(near.place(texts[at : at + BLOCK_TEXTS])) for at in range(0, len(texts), BLOCK_TEXTS)]
            scores = np.clip(np.concatenate(blocks) if blocks else np.zeros(0), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file_id").cast(pa.int64()), pa.array(scores, pa.float64())], names=["file_id", "score"]
            )

    scored = files.select("file_id", whole_text().alias("tag_text")).mapInArrow(score, "file_id bigint, score double")
    return scored.select(
        "file_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [text_terms(t) for t in pc.cast(batch.column("tag_text"), pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("file_id").cast(pa.int64()),
                batch.column("archived").cast(pa.int32()),
                pa.array([t[0] for t in terms], pa.list_(pa.int64())),
                pa.array([t[1] for t in terms], pa.list_(pa.float32())),
            ],
            names=["file_id", "archived", "places", "amounts"],
        )

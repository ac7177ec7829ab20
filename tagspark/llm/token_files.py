"""Token ids of tag texts as binary files: ids end to end, text boundaries in Elias-Fano code.

A folder holds one file per range of `file_id`, and a file holds blocks in ascending order. A block
is the ids of consecutive texts end to end, in two or four bytes each, where its texts end, and
which files they belong to; both lists are ascending and coded in a few bits per text (see
`elias_fano`). The blocks are binary columns of Parquet files, so that Spark's writers, commit
protocol and file systems serve them like any table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tagspark.llm import elias_fano
from tagspark.llm.texts import whole_text
from tagspark.llm.tokens import encoder

END_ID = 2
# Ids in a block before it is closed; only a longer text makes a longer block.
BLOCK_IDS = 1 << 20
# Characters of a text that bound a range of rows with one id.
BOUND_CHARS = 100
# Small row groups let readers split a file between blocks.
GROUP_BYTES = 16 << 20

_BLOCK = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("n_ids", pa.int64()),
        ("id_bytes", pa.int32()),
        ("n_nulls", pa.int64()),
        ("first_file", pa.int64()),
        ("files", pa.binary()),
        ("ends", pa.binary()),
        ("ids", pa.binary()),
    ]
)
_BLOCK_SQL = (
    "shard int, block int, n_ids bigint, id_bytes int, n_nulls bigint, first_file bigint, files binary, ends binary, ids binary"
)
_READ_SQL = "file_id bigint, shard int, block int, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"


def write_token_files(
    files: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS
) -> None:
    """Write the ids of every whole text of `files` (file_id, tag_text) to a new folder `path`.

    Texts are encoded by the vocabulary file at `vocabulary` and followed by `end_id`. They stand
    in ascending order of `file_id`, null ids first; rows that repeat an id stand next to each
    other in the order of their texts. An id may be very many rows: ranges are bounded by id and
    the start of the text, so that only rows equal in both share one. A null text counts as empty
    and is its end id alone. An empty table gives a folder without blocks. Further columns are
    ignored.
    """
    # Bounds are sampled; the start of a text keeps the sample small, and sorts as the text does.
    ranged = (
        files.select("file_id", whole_text().alias("tag_text"))
        .repartitionByRange("file_id", F.substring("tag_text", 1, BOUND_CHARS))
        .sortWithinPartitions("file_id", "tag_text")
        .withColumn("shard", F.spark_partition_id())
    )
    blocks = ranged.mapInArrow(lambda batches: _write(batches, vocabulary, end_id, block_ids), _BLOCK_SQL)
    blocks.write.option("parquet.block.size", GROUP_BYTES).parquet(path)


def _write(batches, vocabulary: str, end_id: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary, added_tokens=True).encode
    end = int(end_id).to_bytes(4, "little")
    block, size = 0, 0
    held: list[tuple] = []
    shard = None
    for batch in batches:
        shard = batch.column("shard")[0].as_py() if batch.num_rows else shard
        for file_id, text in zip(batch.column("file_id").to_pylist(), batch.column("tag_text").to_pylist(), strict=True):
            ids = encode(text) + end
            held.append((file_id, ids))
            size += len(ids) // 4
            if size >= block_ids:
                yield _block(shard, block, held)
                block, size, held = block + 1, 0, []
    if held:
        yield _block(shard, block, held)


def _block(shard: int, block: int, held: list[tuple]) -> pa.RecordBatch:
    ends = np.cumsum([len(ids) // 4 for _, ids in held])
    ids = np.frombuffer(b"".join(ids for _, ids in held), "<u4")
    id_bytes = 2 if ids.max() < 1 << 16 else 4
    known = [f for f, _ in held if f is not None]
    first = known[0] if known else 0
    apart = np.array([f - first for f in known], np.uint64)
    row = [
        shard,
        block,
        len(ids),
        id_bytes,
        len(held) - len(known),
        first,
        elias_fano.encode(apart),
        elias_fano.encode(ends),
        ids.astype(f"<u{id_bytes}").tobytes(),
    ]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)


def ids_of(block: dict, i: int) -> np.ndarray:
    """The ids of the i-th text of a block row: two look-ups in its boundaries, nothing decoded."""
    ends = elias_fano.EliasFano(block["ends"])
    start = ends.select(i - 1) if i else 0
    ids = np.frombuffer(block["ids"], f"<u{block['id_bytes']}")
    return ids[start : ends.select(i)].astype("<u4")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per text of a folder of token files.

    Returns file_id, start (ids of all texts before it in the folder), n_tokens, ids_crc32 (of the
    ids as unsigned 32-bit little-endian numbers) and ids in that form, null unless `with_ids`.
    """
    blocks = spark.read.schema(_BLOCK_SQL).parquet(path)
    texts = blocks.mapInArrow(lambda batches: _read(batches, with_ids), _READ_SQL)
    # Ids before a block: those of earlier files, one row each, and of earlier blocks of its file.
    sizes = blocks.select("shard", "block", "n_ids")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select(
        "shard", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("_shard_start")
    )
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_block_start", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(shards, "shard")
    return texts.join(starts.drop("n_ids"), ["shard", "block"]).select(
        "file_id",
        (F.col("_shard_start") + F.col("_block_start") + F.col("start")).alias("start"),
        "n_tokens",
        "ids_crc32",
        "ids",
    )


def _read(batches, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.to_pylist():
            coded = elias_fano.EliasFano(block["ends"])
            ends = np.array([coded.select(i) for i in range(len(coded))], np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            apart = elias_fano.EliasFano(block["files"]).all()
            files = [None] * block["n_nulls"] + [block["first_file"] + int(x) for x in apart]
            ids = np.frombuffer(block["ids"], f"<u{block['id_bytes']}").astype("<u4")
            texts = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
            n = len(texts)
            yield pa.RecordBatch.from_pydict(
                {
                    "file_id": pa.array(files, pa.int64()),
                    "shard": pa.array([block["shard"]] * n, pa.int32()),
                    "block": pa.array([block["block"]] * n, pa.int32()),
                    "start": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(ends - starts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in texts], pa.int64()),
                    "ids": pa.array(texts if with_ids else [None] * n, pa.binary()),
                }
            )

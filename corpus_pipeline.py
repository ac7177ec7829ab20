"""A corpus pipeline over `documents`: rules, exact copies, near copies, mixing, packing.

Each stage works on all that its predecessor kept and returns the columns of `documents`, so its
result can be written and read again; the last one returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from tagspark.llm import block_names, fair_mix, packing, rule_ledger, simhash
from tagspark.llm.queries import VOCABULARY, as_documents, as_files, table
from tagspark.session import cut_lineage

# Ids, sequences and shuffled order have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None
ROW = "_pipeline_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number of their own that stays whatever way their files are split.

    A file's name and a row's place in it make the number, so nothing is written for it; rows that
    are not read from files are numbered once and written. Two rows may share a number by chance,
    so rows are found again by their number and doc_id.
    """
    try:
        return docs.withColumn(ROW, F.xxhash64("_metadata.file_name", "_metadata.row_index"))
    except AnalysisException:
        return cut_lineage(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _decided(docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of `docs` with what an operator says of them; it hands their number and file_id through."""
    numbered = _numbered(docs)
    decided = decide(as_files(numbered, ROW)).withColumnsRenamed({"file_id": "_decided_id", ROW: "_decided_row"})
    same = (F.col(ROW) == F.col("_decided_row")) & F.col("doc_id").eqNullSafe(F.col("_decided_id"))
    return numbered.join(decided, same).drop("_decided_row", "_decided_id")


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rules of the policy `v1`; documents that it rejects go."""

    def decide(files: DataFrame) -> DataFrame:
        return rule_ledger.apply_policy(rule_ledger.rule_ledger(files, carry=docs.columns), "v1")

    renamed = docs.withColumns({"file_id": F.col("doc_id"), "tag_text": F.col("text")})
    return decide(renamed).where("kept").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    found = _decided(docs, lambda files: block_names.duplicate_files(files, key=ROW).where("kept").select(ROW, "file_id"))
    return found.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document that names it stays."""
    found = _decided(docs, lambda files: simhash.near_duplicates(files, key=ROW).where("kept").select(ROW, "file_id"))
    return found.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix holds it."""
    mixed = _decided(docs, lambda files: fair_mix.fair_mix(files, key=ROW).where("times > 0").select(ROW, "file_id", "times"))
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return as_documents(packing.pack_files(as_files(docs), VOCABULARY, with_ids=False).drop("ids"))


STAGES = [
    ("quality_rules", reject_by_rules),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Label tables and classifier artifacts: reading and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagspark.defaults import (
    MIN_LABEL_BYTES,
    MIN_LABEL_ROWS,
    MIN_MODEL_BYTES,
    REQUIRED_ARTIFACTS,
    REQUIRED_LABEL_COLUMNS,
)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(label_idx, tag_id, name, category, count); label_idx is the row number in the file.

    The file is one vocabulary. Read as one piece (`multiLine`), its rows keep their order; several
    files have no order among them and are rejected.
    """
    table = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if len(table.inputFiles()) > 1:
        raise ValueError(f"a label table is one file, {path} is several")
    number = {c: F.col(c).try_cast("int") for c in ("tag_id", "category", "count") if c in table.columns}
    return table.select(
        F.monotonically_increasing_id().cast("int").alias("label_idx"),
        *[number.get(c, F.col(c)).alias(c) for c in ("tag_id", "name", "category", "count") if c in table.columns],
    )


def check_labels(labels: DataFrame) -> DataFrame:
    """Issues of a label table, one row each; no rows when it is sound. An empty file has no header."""
    named = {c.strip() for c in labels.columns} - {"label_idx", ""}
    missing = [c for c in REQUIRED_LABEL_COLUMNS if c not in named]
    spark = labels.sparkSession
    if not named:
        return spark.range(1).select(F.lit("csv_missing_header").alias("issue"))
    if missing:
        return spark.range(1).select(F.lit(f"csv_missing_columns:{missing}").alias("issue"))
    few = labels.limit(MIN_LABEL_ROWS).agg(F.count("*").alias("n")).where(F.col("n") < MIN_LABEL_ROWS)
    return few.select(F.concat(F.lit("csv_too_few_rows:"), F.col("n").cast("string")).alias("issue"))


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """(model, file, length) of stored artifacts; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, -2).alias("model"), F.element_at(parts, -1).alias("file"), "length"
    )


def read_manifests(rows: DataFrame, text: str = "value") -> DataFrame:
    """(model, revision, sizes) from manifest JSON text; sizes maps file name to recorded bytes."""
    doc = F.try_parse_json(text)
    sizes = F.try_variant_get(doc, "$.files", "map<string,variant>")
    known = F.map_filter(
        F.transform_values(sizes, lambda _, v: F.try_variant_get(v, "$.size", "bigint")),
        lambda _, v: v.isNotNull(),
    )
    return rows.select(
        F.try_variant_get(doc, "$.model_name", "string").alias("model"),
        F.nullif(F.try_variant_get(doc, "$.revision_sha", "string"), F.lit("")).alias("revision"),
        known.alias("sizes"),
    )


def verify_artifacts(
    models: DataFrame,
    listing: DataFrame,
    manifests: DataFrame,
    label_issues: DataFrame | None = None,
    remote: DataFrame | None = None,
    supported: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Per model: ok, issues, manifest_present, local_revision, remote_revision, stale.

    `label_issues` holds (model, issue) from `check_labels`, `remote` (model, remote_revision).
    Revision issues are notes and do not make a model unsound. `supported` holds the names of
    known models, as a list or a table with `model`; any other one is an `unknown_model`, and
    nothing else is said of it. Without it all models are known.
    """
    onnx, csv = REQUIRED_ARTIFACTS
    sizes = listing.groupBy("model").agg(
        *[F.max(F.when(F.col("file") == f, F.col("length"))).alias(a) for f, a in ((onnx, "_onnx"), (csv, "_csv"))]
    )
    joined = models.join(sizes, "model", "left").join(
        manifests.withColumn("_manifest", F.lit(True)), "model", "left"
    )
    if label_issues is not None:
        listed = label_issues.groupBy("model").agg(F.array_sort(F.collect_set("issue")).alias("_labels"))
        joined = joined.join(listed, "model", "left")
    else:
        joined = joined.withColumn("_labels", F.lit(None).cast("array<string>"))
    if remote is not None:
        joined = joined.join(remote, "model", "left")
    else:
        joined = joined.withColumn("remote_revision", F.lit(None).cast("string"))

    if isinstance(supported, DataFrame):
        names = supported.select("model").distinct().withColumn("_known", F.lit(True))
        joined = joined.join(names, "model", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    else:
        joined = joined.withColumn("_known", F.lit(True) if supported is None else F.coalesce(F.col("model").isin(list(supported)), F.lit(False)))

    def issue(condition: Column, text: Column | str) -> Column:
        return F.when(condition, F.lit(text) if isinstance(text, str) else text)

    def small(name: str, size: str, least: int) -> Column:
        return issue(F.col(size) < least, F.concat(F.lit(f"{name}_too_small:"), F.col(size).cast("string")))

    def mismatch(file: str, size: str) -> Column:
        recorded = F.try_element_at("sizes", F.lit(file))
        return issue(recorded != F.col(size), f"size_mismatch_vs_manifest:{file}")

    absent = F.col("_onnx").isNull() | F.col("_csv").isNull()
    found = F.concat(
        F.array(small("onnx", "_onnx", MIN_MODEL_BYTES), small("csv", "_csv", MIN_LABEL_BYTES)),
        F.coalesce("_labels", F.array().cast("array<string>")),
        F.array(mismatch(onnx, "_onnx"), mismatch(csv, "_csv")),
    )
    stale = F.col("remote_revision") != F.col("revision")
    notes = F.array(
        issue(F.coalesce(stale, F.lit(False)), "newer_revision_on_hub"),
        issue(
            F.col("remote_revision").isNotNull() & F.col("revision").isNull(),
            "manifest_missing_revision_cannot_compare_hub",
        ),
    )
    known, absent = F.col("_known"), absent | ~F.col("_known")
    hard = F.when(~known, F.array(F.lit("unknown_model"))).when(absent, F.array(F.lit("missing_required_files"))).otherwise(F.array_compact(found))
    soft = F.when(absent, F.array().cast("array<string>")).otherwise(F.array_compact(notes))
    return joined.select(
        "model",
        (F.size(hard) == 0).alias("ok"),
        F.concat(hard, soft).alias("issues"),
        (known & F.coalesce("_manifest", F.lit(False))).alias("manifest_present"),
        F.when(known, F.col("revision")).alias("local_revision"),
        F.when(~absent, F.col("remote_revision")).alias("remote_revision"),
        F.when(~absent & stale, F.lit(True)).alias("stale"),
    )

"""Markdown corpus and PDF blobs on a shared file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlake.functions.identifiers import canonical_from_stem, stem
from litlake.sources.files import read_named

MAX_PDF_BYTES = 200_000_000
PDF_MARK = b"%PDF-"


def read_markdown_corpus(spark: SparkSession, root: str, namespace: str | None = None) -> DataFrame:
    """``<root>/<namespace>/markdown/*.md`` as ``(namespace, stem, canonical_id, markdown)``.

    One row per file, empty ones too. A namespace filter narrows the file listing itself.
    Undecodable bytes are replaced, they do not fail the read.
    """
    files = read_named(spark, root, namespace, "markdown", ".md")
    return files.select(
        "namespace",
        "stem",
        canonical_from_stem(F.col("namespace"), F.col("stem")).alias("canonical_id"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("markdown"),
    )


def write_corpus(df: DataFrame, root: str, mode: str = "append") -> None:
    """Persist a corpus as a table partitioned by namespace, keyed by stem."""
    df.select(
        "namespace",
        "canonical_id",
        stem(F.col("canonical_id")).alias("stem"),
        "markdown",
        F.sha2("markdown", 256).alias("md_sha256"),
    ).write.mode(mode).partitionBy("namespace").parquet(root)


def write_clustered(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Persist a corpus in the order of its names, with filters on them, for fetching few texts.

    Row groups are small, and each knows the ids it may hold: a scan for some ids
    skips the others' texts.
    """
    placed = df.select("namespace", "canonical_id", "markdown").repartitionByRange(
        "namespace", "canonical_id"
    )
    named = placed.sortWithinPartitions("namespace", "canonical_id")
    named.withColumn("md_sha256", F.sha2("markdown", 256)).write.mode(mode).option("parquet.block.size", str(4 << 20)).option(
        "parquet.bloom.filter.enabled#canonical_id", "true"
    ).option("parquet.bloom.filter.expected.ndv#canonical_id", "10000").parquet(root)


def read_corpus(spark: SparkSession, root: str, namespace: str | None = None) -> DataFrame:
    df = spark.read.parquet(root)
    return df.where(F.col("namespace") == namespace) if namespace else df


def read_pdf_blobs(
    spark: SparkSession,
    path: str,
    max_bytes: int = MAX_PDF_BYTES,
    expected: DataFrame | None = None,
) -> DataFrame:
    """PDF files with ``content``; rejects keep an ``error`` and no content.

    The size check comes first and only needs the listing; over-size files are
    never opened. Spark's file sources skip files of zero length when they plan the
    scan; with a manifest ``expected(path)``, each of its files that the scan
    doesn't show is a reject row of length 0.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    too_big = files.where(F.col("length") > max_bytes).select(
        "path",
        "length",
        F.lit(None).cast("binary").alias("content"),
        F.concat(F.lit("File exceeds "), F.lit(str(max_bytes)), F.lit(" bytes")).alias("error"),
    )
    is_pdf = F.substring("content", 1, len(PDF_MARK)) == F.lit(PDF_MARK)
    readable = files.where(F.col("length") <= max_bytes).select(
        "path",
        "length",
        F.when(is_pdf, F.col("content")).alias("content"),
        F.when(~is_pdf, F.lit("Not a PDF: missing %PDF- header")).alias("error"),
    )
    found = readable.unionByName(too_big)
    if expected is None:
        return found
    missing = expected.select("path").distinct().join(files.select("path"), "path", "left_anti")
    return found.unionByName(
        missing.select(
            "path",
            F.lit(0).cast("long").alias("length"),
            F.lit(None).cast("binary").alias("content"),
            F.lit("Empty or missing file").alias("error"),
        )
    )

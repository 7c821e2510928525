"""Identifier resolution over DataFrames of raw identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlake.functions import identifiers as ids

DOWNLOAD_ERROR = (
    "No automatic PDF address for this identifier: only arXiv ids, preprint DOIs "
    "(10.1101/...) and anthology DOIs (10.18653/v1/...) have one."
)
DOWNLOAD_HINT = (
    "Obtain the file yourself and import it under the same identifier; "
    "markdown files skip conversion."
)
IMPORT_ERROR = "Unsupported file extension. Expected .pdf or .md/.markdown."


def resolve_identifiers(df: DataFrame, col: str = "raw") -> DataFrame:
    """Add ``normalized, source, namespace, canonical_id, key_sha`` for each raw id.

    Metadata routing (``source``) and storage routing (``namespace``) differ:
    an arbitrary DOI has work metadata but is stored under ``manual``. The
    steps build on each other so that every pattern runs once per row.
    """
    bare, arxiv, preprint = F.col("_bare"), F.col("_arxiv"), F.col("_preprint")
    steps = (
        df.withColumns({"_bare": ids.bare_doi(F.col(col)), "_arxiv": ids.bare_arxiv(F.col(col))})
        .withColumns(
            {
                "_preprint": ids.content_doi(bare),
                "_is_arxiv": arxiv.rlike(ids.ARXIV_NEW) | arxiv.rlike(ids.ARXIV_OLD),
                "_is_doi": bare.rlike(ids.DOI),
            }
        )
        .withColumns(
            {
                "_route": F.when(F.col("_is_arxiv"), F.lit("arxiv"))
                .when(bare.startswith(ids.ANTHOLOGY_PREFIX), F.lit("acl_anthology"))
                .when(preprint.startswith(ids.PREPRINT_PREFIX), F.lit("biorxiv"))
                .otherwise(F.lit("manual")),
            }
        )
        .withColumns(
            {
                "_normal": F.when(F.col("_route") == "arxiv", arxiv)
                .when(F.col("_route") == "biorxiv", preprint)
                .otherwise(bare),
                "_canonical": F.when(F.col("_route") == "arxiv", ids.unversioned(arxiv))
                .when(F.col("_route") == "biorxiv", F.lower(preprint))
                .otherwise(F.lower(bare)),
            }
        )
    )
    return steps.select(
        *df.columns,
        F.col("_normal").alias("normalized"),
        F.when(F.col("_route").isin("arxiv", "biorxiv"), F.col("_route"))
        .when(F.col("_is_doi"), F.lit("openalex"))
        .alias("source"),
        F.col("_route").alias("namespace"),
        F.col("_canonical").alias("canonical_id"),
        ids.key_sha(F.col("_canonical")).alias("key_sha"),
    )


def resolve_author_ids(df: DataFrame, col: str = "author_id") -> DataFrame:
    return df.withColumn("author_key", ids.author_key(F.col(col)))


def record_keys(df: DataFrame, col: str = "canonical_id") -> DataFrame:
    return df.withColumn("key_sha", ids.key_sha(F.col(col)))


def storage_names(df: DataFrame) -> DataFrame:
    """File stem of each stored paper and the id read back from that stem."""
    stem = ids.stem(F.col("canonical_id"))
    return df.select(
        "*",
        stem.alias("stem"),
        ids.canonical_from_stem(F.col("namespace"), stem).alias("restored_id"),
    )


def plan_downloads(df: DataFrame, col: str = "raw") -> DataFrame:
    """PDF address where one can be derived from the id alone, else error + hint.

    Preprints take version and server from optional ``version`` and ``server``
    columns, as their record has them; without these, version 1 and the server that
    an address names, else bioRxiv. arXiv addresses come from an optional ``links`` column, as the
    paper's record lists them, and otherwise follow from the bare id.
    """
    resolved = resolve_identifiers(df, col)
    on_med = F.coalesce(F.lower(F.col("server")) == "medrxiv", F.lit(False)) if "server" in df.columns else (
        F.coalesce(F.lower(F.col(col)).contains("medrxiv.org"), F.lit(False))
    )
    server = F.when(on_med, F.lit("medrxiv")).otherwise(F.lit("biorxiv"))
    version = F.coalesce(F.col("version"), F.lit("1")) if "version" in df.columns else F.lit("1")
    url = (
        F.when(
            F.col("namespace") == "arxiv",
            F.get(F.filter("links", lambda k: k["title"] == "pdf"), F.lit(0))["href"]
            if "links" in df.columns
            else F.concat(F.lit("https://arxiv.org/pdf/"), F.col("normalized")),
        )
        .when(
            F.col("namespace") == "acl_anthology",
            F.concat(F.lit("https://aclanthology.org/"), ids.anthology_id(F.col("normalized")), F.lit(".pdf")),
        )
        .when(
            F.col("namespace") == "biorxiv",
            F.concat(
                F.lit("https://www."),
                server,
                F.lit(".org/content/"),
                F.col("normalized"),
                F.lit("v"),
                version,
                F.lit(".full.pdf"),
            ),
        )
    )
    return resolved.select(
        *df.columns,
        "namespace",
        "canonical_id",
        url.alias("pdf_url"),
        F.when(url.isNull(), F.lit(DOWNLOAD_ERROR)).alias("error"),
        F.when(url.isNull(), F.lit(DOWNLOAD_HINT)).alias("suggestion"),
    )


def route_imports(df: DataFrame, col: str = "path") -> DataFrame:
    """Dispatch files by extension: ``pdf``, ``markdown`` or an error."""
    ext = F.lower(F.regexp_extract(F.col(col), r"[^/.][^/]*(\.[^./]+)$", 1))
    route = F.when(ext == ".pdf", F.lit("pdf")).when(
        ext.isin(".md", ".markdown"), F.lit("markdown")
    )
    return df.select(
        "*",
        ext.alias("extension"),
        route.alias("route"),
        F.when(route.isNull(), F.lit(IMPORT_ERROR)).alias("error"),
    )

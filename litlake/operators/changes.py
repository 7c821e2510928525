"""Change feed: what differs between a corpus and what was derived from it, and only that derived anew.

A manifest holds the checksum of every document that sections and search index were derived
from. One comparison of narrow columns gives the changed documents; their texts alone are
read, and their sections, statistics and postings stored beside the older ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlake.operators import index
from litlake.operators.sections import DOC, section_index
from litlake.operators.spread import first_per_key, match_keys
from litlake.session import pin

#: Changed documents up to which their ids are pushed into the scan of the texts.
FETCH = 1000

_MANIFEST = "namespace string, canonical_id string, md_sha256 string, version long"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """``namespace, canonical_id, md_sha256``: documents as last derived; removed ones are absent."""
    return _entries(spark, root).where("md_sha256 is not null").drop("version")


def _entries(spark: SparkSession, root: str) -> DataFrame:
    _, place, files = index.files_at(spark, f"{root}/manifest")
    if not files.exists(place):
        return spark.createDataFrame([], _MANIFEST)
    rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    return first_per_key(rows, DOC, [F.col("version").desc(), F.col("md_sha256").asc()])


def changed_documents(corpus: DataFrame, known: DataFrame) -> DataFrame:
    """``namespace, canonical_id, change, md_sha256``: added, changed and removed documents.

    ``corpus`` needs (namespace, canonical_id, md_sha256); texts aren't read. ``known`` is a
    manifest. Of repeated rows of a document the one with the smallest checksum counts.
    """
    now = corpus.groupBy(*DOC).agg(F.min("md_sha256").alias("md_sha256"))
    was = known.select(*DOC, F.col("md_sha256").alias("_was"))
    change = (
        F.when(F.col("_was").isNull(), "added")
        .when(F.col("md_sha256").isNull(), "removed")
        .when(F.col("md_sha256") != F.col("_was"), "changed")
    )
    both = now.join(was, DOC, "full").withColumn("change", change)
    return both.where("change is not null").select(*DOC, "change", "md_sha256")


def changed_texts(corpus: DataFrame, changes: DataFrame) -> DataFrame:
    """Texts of the added and changed documents.

    Up to FETCH ids go to the scan as a list; a corpus written by ``write_clustered``
    then gives up only row groups that may hold one. More are matched by a join.
    """
    wanted = changes.where("change <> 'removed'").select(*DOC, "md_sha256")
    some = wanted.limit(FETCH + 1).collect()
    if len(some) <= FETCH:
        corpus = corpus.where(F.col("canonical_id").isin(*{r.canonical_id for r in some}) if some else F.lit(False))
    found = match_keys(corpus, wanted, [*DOC, "md_sha256"], "left_semi")
    return found.select(*DOC, "markdown", "md_sha256").dropDuplicates(DOC)


def apply_changes(spark: SparkSession, root: str, corpus: DataFrame) -> DataFrame:
    """Bring sections and search index under ``root`` up to ``corpus``; returns the changes.

    Only changed texts are read. Sections of earlier versions stay until compaction;
    readers take those that the manifest names. It is written last: a job that
    dies before does its changes again, with the same result.
    """
    entries = _entries(spark, root)
    changes = pin(changed_documents(corpus, manifest(spark, root)), "changes")
    if changes.isEmpty():
        return changes
    version = entries.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
    stamp = F.lit(version).cast("long").alias("version")
    texts = pin(changed_texts(corpus, changes), "texts")
    section_index(texts).select("*", stamp).write.mode("append").parquet(f"{root}/sections")
    index.remove_documents(spark, f"{root}/index", changes.where("change = 'removed'"))
    if not texts.isEmpty():
        index.add_documents(spark, f"{root}/index", texts.select(*DOC, "markdown"))
    kept = F.when(F.col("change") != "removed", F.col("md_sha256")).alias("md_sha256")
    changes.select(*DOC, kept, stamp).write.mode("append").parquet(f"{root}/manifest")
    return changes


def current_sections(spark: SparkSession, root: str) -> DataFrame:
    """Stored sections of every live document, as last derived."""
    rows = spark.read.parquet(f"{root}/sections")
    live = manifest(spark, root)
    newest = first_per_key(rows, [*DOC, "md_sha256"], [F.col("version").desc()])
    return newest.join(live, [*DOC, "md_sha256"], "left_semi").drop("version")

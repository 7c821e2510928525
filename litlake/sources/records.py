"""Record store on Parquet, partitioned by namespace, entity and key bucket.

Writers append small batches or merge large ones; readers always see the newest
entry of a key. ``seq`` orders entries that carry the same time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlake.operators.spread import first_per_key
from litlake.session import pin

KEY = ["namespace", "entity", "key"]
PARTS = ["namespace", "entity", "bucket"]
BUCKETS = 64
SCHEMA = (
    "key string, payload string, stored_at timestamp_ntz, seq bigint, "
    "namespace string, entity string, bucket int"
)


def _newest(*between: Column) -> list[Column]:
    """Order of a key's entries, the valid one first."""
    return [
        F.col("stored_at").desc(), *between, F.col("seq").desc(), F.col("payload").asc(),
    ]


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(root)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], SCHEMA)
        raise


def _incoming(df: DataFrame, seq: int, buckets: int) -> DataFrame:
    return df.select(
        "key", "payload", "stored_at", F.lit(seq).cast("long").alias("seq"), "namespace", "entity"
    ).withColumn("bucket", _bucket(buckets))


def judged_records(
    spark: SparkSession, root: str, namespace: str | None = None, entity: str | None = None
) -> DataFrame:
    """The newest entry of each key, with ``quarantined``: its payload is not JSON.

    Only the asked partitions are scanned, once.
    """
    df = _stored(spark, root)
    if namespace:
        df = df.where(F.col("namespace") == namespace)
    if entity:
        df = df.where(F.col("entity") == entity)
    rows = first_per_key(df, KEY, _newest()).drop("bucket", "seq")
    return rows.withColumn("quarantined", F.try_parse_json("payload").isNull())


def read_records(
    spark: SparkSession, root: str, namespace: str | None = None, entity: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(records, quarantined)``: rows whose payload is not JSON count as absent.

    Each of the two scans the store; who wants both takes :func:`judged_records`.
    """
    rows = judged_records(spark, root, namespace, entity)
    good, bad = rows.where("not quarantined"), rows.where("quarantined")
    return good.drop("quarantined"), bad.drop("quarantined")


def append_records(df: DataFrame, root: str, seq: int, buckets: int = BUCKETS) -> None:
    """Put a small batch: its rows are added, nothing is rewritten.

    ``seq`` grows from batch to batch. Appending a batch twice changes nothing
    for readers.
    """
    (
        _incoming(df, seq, buckets)
        .repartitionByRange(*PARTS, "key")
        .write.mode("append")
        .partitionBy(*PARTS)
        .parquet(root)
    )


def upsert_records(df: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Put a large batch and merge it: the newest ``stored_at`` per key wins.

    Only the (namespace, entity, bucket) folders the batch touches are read and
    rewritten, older entries in them included; ``buckets`` belongs to the store
    and must not change over its life. The merge is written to scratch first, so
    a job that dies leaves the store as it was. Ranges over (folder, key) split
    a big folder over tasks.
    """
    spark = df.sparkSession
    incoming = _incoming(df, 0, buckets)
    touched = incoming.select(*PARTS).distinct()
    old = _stored(spark, root).join(touched, PARTS, "left_semi")
    both = old.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    _rewrite(first_per_key(both, KEY, _newest(F.col("_new").desc())).drop("_new"), root)


def compact_records(spark: SparkSession, root: str) -> None:
    """Fold appended batches into one entry per key."""
    _rewrite(first_per_key(_stored(spark, root), KEY, _newest()), root)


def _rewrite(latest: DataFrame, root: str) -> None:
    """Replace the folders that ``latest`` has rows for."""
    merged = pin(latest.withColumn("seq", F.lit(0).cast("long")), "merge")
    (
        merged.repartitionByRange(*PARTS, "key")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTS)
        .parquet(root)
    )

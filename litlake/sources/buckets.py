"""Parquet tables bucketed by key, so that grouping and joining on the key don't shuffle them."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def _name(path: str) -> str:
    return f"litlake_{hashlib.md5(path.encode()).hexdigest()}"


def write_bucketed(
    df: DataFrame, path: str, key: str, buckets: int, order: Sequence[str] = ()
) -> DataFrame:
    """``df`` dealt by ``key`` to ``buckets`` files, each sorted by ``order``; returns the table."""
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet")
    writer = writer.bucketBy(buckets, key).option("path", path)
    if order:
        writer = writer.sortBy(*order)
    writer.saveAsTable(_name(path))
    return df.sparkSession.table(_name(path))


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """The table at ``path``; any session may read it, whoever wrote it."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema
        )
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"

_local_roots: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named in ``spark.checkpoint.dir``.

    A temporary folder serves where the setting is missing and the master is
    local, as in tests; on a cluster a missing setting is an error.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    return _local_roots.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-"))


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage ends there."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str, kind: str) -> Column:
    """Column ``name`` as ``kind``; null where the table lacks it."""
    return (df[name] if name in df.columns else F.lit(None)).cast(kind).alias(name)


def only(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash with ours."""
    return df.select(*(column(df, n, k) for n, k in kinds.items()))


def by_batch(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: StructType | str
) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; no order or grouping is implied."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(batches, schema)


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


#: A-Z to a-z and nothing else, on UTF-8 bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Rows of narrow keys that may be broadcast: some tens of megabytes at most.
BROADCAST_ROWS = 1_000_000


def if_small(keys: DataFrame) -> DataFrame:
    """``keys``, written once and marked for broadcast if it has at most BROADCAST_ROWS rows.

    For rows of a few numbers. More of them join by a shuffle, with the same result.
    """
    keys = written(keys, "keys")
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

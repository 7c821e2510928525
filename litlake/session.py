"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "litlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution stays on: it sizes shuffle partitions, switches joins to
    broadcast only when the measured side is small, and splits skewed joins.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Large texts and files reach Python a few at a time.
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_roots: dict[str, str] = {}


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session.

    Without the setting a temporary folder serves on a local master, where driver
    and tasks share the disk; on a cluster that is an error.
    """
    shared = spark.conf.get(CHECKPOINT_CONF, None)
    if shared:
        return shared.rstrip("/")
    if not _is_local(spark):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the session's own part of the shared folder."""
    return f"{_own_root(spark)}/{label}-{uuid.uuid4().hex}"


def _own_root(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/litlake/{spark.sparkContext.applicationId}"


def release_scratch(spark: SparkSession) -> None:
    """Remove everything this session has pinned; call it when its results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pin(df: DataFrame, label: str = "pinned") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, fixes the row order
    within files, and gives the planner real sizes for its broadcast checks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

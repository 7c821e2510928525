"""Named files on a shared file system, written, listed and read by the executors."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlake.functions.identifiers import stem

# A task passes on what it has listed or read once it holds as many names or bytes.
LIST_NAMES = 10_000
READ_BYTES = 32 << 20


def _arrow(uri: str):
    """Arrow's file system for a folder, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def _opens(uri: str) -> bool:
    """Whether Arrow knows the file system; Hadoop has more of them."""
    try:
        return _arrow(uri) is not None
    except (OSError, ValueError, NotImplementedError):
        return False


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark would read it by."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(hadoop).toString()


def write_files(df: DataFrame, root: str) -> DataFrame:
    """Write ``df(path, content binary)`` under ``root``; returns ``(path, size)``.

    Lazy like any transformation. Each file is written under a temporary name
    and moved, so a retried task leaves whole files only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        files, base = _arrow(root)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                target = f"{base}/{path}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                temporary = f"{folder}/_{uuid.uuid4().hex}"
                with files.open_output_stream(temporary) as out:
                    out.write(bytes(content))
                files.move(temporary, target)
            yield pd.DataFrame({"path": batch["path"], "size": batch["content"].map(len)})

    return df.select("path", "content").mapInPandas(run, "path string, size bigint")


def export_markdown(corpus: DataFrame, root: str) -> DataFrame:
    """One ``<namespace>/markdown/<stem>.md`` file per document that has a name and a text."""
    path = F.concat(
        F.col("namespace"), F.lit("/markdown/"), stem(F.col("canonical_id")), F.lit(".md")
    )
    named = corpus.select(path.alias("path"), F.encode("markdown", "UTF-8").alias("content"))
    return write_files(named.dropna(), root)


def _names(files, folder: str) -> Iterator[str]:
    """Names of a folder's files, one by one from a mounted disk; none if there is no such folder."""
    from pyarrow import fs

    if files.type_name != "local":
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        yield from (f.base_name for f in found if f.is_file)
    elif os.path.isdir(folder):
        with os.scandir(folder) as found:
            yield from (f.name for f in found if f.is_file())


def read_named(spark: SparkSession, root: str, namespace: str | None, kind: str, suffix: str) -> DataFrame:
    """``<root>/<namespace>/<kind>/*<suffix>`` as ``(namespace, stem, content binary)``, empty files too.

    The driver learns the namespaces only. A task per namespace lists its files and
    passes the names on as it meets them; all tasks then read the files of their share.
    Where Arrow can't open the store, Hadoop lists it on the driver, whose memory then
    grows with the number of files.
    """
    root = _qualified(spark, root)
    # A number given keeps the shares apart: names are small, their files are not.
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if not _opens(root):
        found = spark.sparkContext.binaryFiles(f"{root}/{namespace or '*'}/{kind}/*{suffix}", shares)
        part = lambda p: F.regexp_extract("path", p, 1)
        return spark.createDataFrame(found, "path string, content binary").select(
            part(rf"/([^/]+)/{kind}/[^/]+$").alias("namespace"),
            part(rf"/([^/]+){re.escape(suffix)}$").alias("stem"),
            "content",
        )
    if namespace is None:
        from pyarrow import fs

        files, base = _arrow(root)
        found = files.get_file_info(fs.FileSelector(base))
        spaces = sorted(f.base_name for f in found if f.type == fs.FileType.Directory)
    else:
        spaces = [namespace]

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _arrow(root)
        for batch in batches:
            for space in batch["namespace"]:
                stems = (n.removesuffix(suffix) for n in _names(files, f"{base}/{space}/{kind}") if n.endswith(suffix))
                while some := list(itertools.islice(stems, LIST_NAMES)):
                    yield pd.DataFrame({"namespace": space, "stem": some})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _arrow(root)
        for batch in batches:
            rows, held = [], 0
            for space, name in zip(batch["namespace"], batch["stem"]):
                with files.open_input_stream(f"{base}/{space}/{kind}/{name}{suffix}", compression=None) as file:
                    rows.append((space, name, file.read()))
                held += len(rows[-1][2])
                if held >= READ_BYTES:
                    yield pd.DataFrame(rows, columns=["namespace", "stem", "content"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["namespace", "stem", "content"])

    folders = spark.createDataFrame([(s,) for s in spaces], "namespace string")
    names = folders.mapInPandas(listed, "namespace string, stem string")
    return names.repartition(shares, "namespace", "stem").mapInPandas(
        read, "namespace string, stem string, content binary"
    )

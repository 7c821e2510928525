"""Corpus jobs: importing, converting and invalidating stored text."""

from __future__ import annotations

import contextlib
import multiprocessing
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlake.operators.identifiers import resolve_identifiers
from litlake.operators.normalize import clean_converted_markdown
from litlake.operators.sections import DOC, document_key
from litlake.operators.spread import keyed_join, match_keys

DECODE_ERROR = "Could not decode the file as UTF-8. Re-save it as UTF-8 and retry."


def import_markdown(files: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add texts under user-chosen ids; returns ``(corpus, outcomes)``.

    ``files(pos, identifier, content binary)``. Text that is not UTF-8 is
    reported, never stored. A document that is already stored wins over new
    bytes; among new files for one id the earliest wins, and the later ones find
    it stored. Who wins is settled on narrow rows; contents are read for winners only.
    """
    routed = resolve_identifiers(files, "identifier").withColumn(
        "_valid", F.is_valid_utf8(F.col("content").cast("string"))
    )
    narrow = routed.select("pos", "identifier", *DOC, document_key().alias("_doc"), "_valid")
    stored = corpus.select(document_key().alias("_doc"), F.lit(True).alias("_stored"))
    first = narrow.groupBy("_doc").agg(F.min(F.when(F.col("_valid"), F.col("pos"))).alias("_first"))
    known = keyed_join(keyed_join(narrow, stored.distinct(), "_doc"), first, "_doc")
    stored_before = F.coalesce("_stored", F.lit(False)) | F.coalesce(
        F.col("_first") < F.col("pos"), F.lit(False)
    )
    outcome = known.select(
        "pos",
        "identifier",
        *DOC,
        stored_before.alias("cached"),
        F.when(~stored_before & ~F.col("_valid"), F.lit(DECODE_ERROR)).alias("error"),
    )
    winners = first.where("_first is not null").join(stored, "_doc", "left_anti")
    winners = winners.select(F.col("_first").alias("pos"))
    fresh = routed.join(winners, "pos", "left_semi").select(
        *DOC, F.decode("content", "UTF-8").alias("markdown")
    )
    return corpus.select(*DOC, "markdown").unionByName(fresh), outcome


Converter = Callable[[bytes], str]


#: Seconds that one conversion may take.
TIME_LIMIT = 1800.0


class Isolated:
    """A converter in a child process of the worker, one file at a time.

    A file that takes longer than ``limit`` seconds, or that ends the process, costs
    its own conversion only: the child is killed and the next file gets a new one.
    """

    def __init__(self, converter: Converter, limit: float):
        self.converter = converter
        self.limit = limit
        self.child = None
        self.pipe = None

    def _start(self) -> None:
        context = multiprocessing.get_context("fork")  # the converter needn't be importable
        self.pipe, other = context.Pipe()
        self.child = context.Process(target=self._serve, args=(other, self.pipe), daemon=True)
        self.child.start()
        other.close()

    def _serve(self, pipe, parents) -> None:
        parents.close()  # so that the end of the worker is seen here
        with contextlib.suppress(EOFError):
            while True:
                blob = pipe.recv_bytes()
                try:
                    answer = (self.converter(blob), None)
                except Exception as exc:  # a bad file must not fail the job
                    answer = (None, f"Conversion failed: {exc}")
                pipe.send(answer)

    def __call__(self, blob: bytes) -> tuple[str | None, str | None]:
        if self.child is None or not self.child.is_alive():
            self.close()
            self._start()
        try:
            # The child reads as we write; a child that never reads is caught by the limit too.
            sender = threading.Thread(target=self._send, args=(blob,), daemon=True)
            sender.start()
            if self.pipe.poll(self.limit):
                return self.pipe.recv()
            error = f"Conversion failed: no result within {self.limit:g} seconds"
        except (EOFError, OSError):
            error = "Conversion failed: the converter's process ended"
        self.close()
        return None, error

    def _send(self, blob: bytes) -> None:
        with contextlib.suppress(OSError):
            self.pipe.send_bytes(blob)

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None


def convert_documents(
    blobs: DataFrame,
    corpus: DataFrame,
    converter: Converter,
    force: bool = False,
    time_limit: float = TIME_LIMIT,
) -> DataFrame:
    """Convert blobs that have no text yet: ``(doc, markdown, error)``.

    ``converter`` is a plain function from bytes to markdown. It runs in a process beside each
    executor's worker; failures, crashes and conversions beyond ``time_limit`` seconds become error
    rows. Arrow batches are bounded in bytes (``spark.sql.execution.arrow.maxBytesPerBatch``), so large
    blobs come one at a time. With ``force`` stored documents are converted again.
    """
    todo = blobs if force else match_keys(blobs, corpus, DOC, "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = Isolated(converter, time_limit)
        try:
            for batch in batches:
                for i, blob in enumerate(batch.column("content")):
                    text, error = (None, "Conversion failed: no content")
                    if blob.is_valid:
                        text, error = convert(blob.as_py())
                    own = [batch.column(c).slice(i, 1) for c in DOC]
                    found = [pa.array([text], pa.string()), pa.array([error], pa.string())]
                    yield pa.RecordBatch.from_arrays([*own, *found], [*DOC, "markdown", "error"])
        finally:
            convert.close()

    schema = "namespace string, canonical_id string, markdown string, error string"
    return clean_converted_markdown(todo.select(*DOC, "content").mapInArrow(run, schema))

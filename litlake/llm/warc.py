"""WARC archives as chunked record tables.

Writing: a payload reaches a task as rows of (record, chunk number, bytes) and is
compressed chunk by chunk behind a header that Spark has computed, so no task
holds a whole record. Reading: archives are decompressed as a stream and give rows
of record, chunk number, bytes and the digest so far; the last chunk of a record
carries its length and its digest.

Files are written below a shared folder under names of their own. The table of
archives lists only those of tasks that succeeded, so a lost executor leaves at
most files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlake.llm.common import only, shared_path, written

#: Bytes of one chunk, and uncompressed bytes after which an archive is closed.
CHUNK = 262_144
ARCHIVE_BYTES = 64_000_000
#: Smallest payload of which equal ones become revisits.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Per page: page_id, url, payload, payload_bytes, digest, kind, refers_to.

    Of records with equal payloads of at least ``least`` bytes that with the largest
    page_id is the response (each of them if that id repeats, or if all ids are
    null); the others revisit it.
    """
    rows = only(pages, page_id="long", url="string", html="string")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = rows.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.col("payload_bytes") >= least
    newest = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("newest"))
    joined = rows.where(large).join(newest, "digest")
    revisit = ~F.col("page_id").eqNullSafe(F.col("newest"))
    columns = ["page_id", "url", "payload", "payload_bytes", "digest"]
    told = joined.select(
        *columns,
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("newest")).alias("refers_to"),
    )
    small = rows.where(~large).select(
        *columns, F.lit("response").alias("kind"), F.lit(None).cast("long").alias("refers_to")
    )
    return told.unionByName(small)


def chunks(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row per chunk of a payload, in order: chunk_no, n_chunks and data beside the header's fields.

    A revisit has one chunk without bytes.
    """
    stored = F.when(F.col("kind") == "response", F.col("payload")).otherwise(F.lit(b""))
    count = F.greatest(F.ceil(F.octet_length("stored") / size), F.lit(1)).cast("int")
    rows = records.withColumn("stored", stored).withColumn("n_chunks", count)
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    data = F.substring(F.col("stored"), F.col("chunk_no") * size + 1, F.lit(size))
    return rows.select(
        "page_id", "url", "payload_bytes", "digest", "kind", "refers_to", "chunk_no", "n_chunks", data.alias("data")
    )


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def _uri(url: str) -> str:
    """A url without bytes that a header line can't hold."""
    return "".join(c if 32 < ord(c) != 127 else f"%{ord(c):02X}" for c in url)


def header(row: dict) -> bytes:
    """Header of a record, blank line and the head of its HTTP block included."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    stored = row["payload_bytes"] if row["kind"] == "response" else 0
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['kind']}",
        f"WARC-Record-ID: {_urn(row['page_id'])}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['digest'])).decode()}",
    ]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_uri(row['url'])}")
    if row["kind"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(row['refers_to'])}"]
    lines.append(f"Content-Length: {len(http) + stored}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http


def write_archives(rows: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records of a chunk table below ``folder``; the table of archives: path, records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = path = member = None
        size = records = 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if out is not None and size >= most:
                        out.close()
                        done.append((path, records))
                        out = None
                    if out is None:
                        path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                        out, size, records = store.open_output_stream(path, compression=None), 0, 0
                    member = zlib.compressobj(3, zlib.DEFLATED, 31)
                    out.write(member.compress(header(row)))
                out.write(member.compress(row["data"] or b""))
                size += len(row["data"] or b"")
                if row["chunk_no"] == row["n_chunks"] - 1:
                    out.write(member.compress(b"\r\n\r\n"))
                    out.write(member.flush())
                    records += 1
        if out is not None:
            out.close()
            done.append((path, records))
        if done:
            paths, counts = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths), pa.array(counts, pa.int64())], ["path", "records"]
            )

    return written(rows.mapInArrow(write, "path string, records long"), "archives")


class _Stream:
    """Bytes of a multi-member gzip file, read as asked for."""

    def __init__(self, raw):
        self.raw = raw
        self.held = b""
        self.rest = b""
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.inflate.eof:
            self.rest = self.inflate.unused_data or self.rest
            self.inflate = zlib.decompressobj(31)
        data = self.rest or self.inflate.unconsumed_tail or self.raw.read(65_536)
        self.rest = b""
        if not data:
            return False
        self.held += self.inflate.decompress(data, CHUNK)
        return True

    def line(self) -> bytes | None:
        while b"\r\n" not in self.held:
            if not self._more():
                return None
        line, _, self.held = self.held.partition(b"\r\n")
        return line

    def block(self, size: int, most: int) -> Iterator[bytes]:
        while size:
            while len(self.held) < min(size, most):
                if not self._more():
                    raise ValueError("an archive ends inside a record")
            part, self.held = self.held[: min(size, most)], self.held[min(size, most) :]
            size -= len(part)
            yield part


def _head(stream: _Stream) -> dict[str, str] | None:
    """Header fields of the next record by lower-case name; None at the end."""
    line = stream.line()
    while line == b"":
        line = stream.line()
    if line is None:
        return None
    fields = {}
    while line := stream.line():
        name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def records(raw, size: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an open archive."""
    stream = _Stream(raw)
    while (fields := _head(stream)) is not None:
        length = int(fields["content-length"])
        http, used = {}, 0
        while line := stream.line():
            used += len(line) + 2
            name, _, value = line.decode("latin-1").partition(":")
            http[name.strip().lower()] = value.strip()
        stored = length - used - 2
        revisit = fields["warc-type"] == "revisit"
        declared = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        digest, number = hashlib.sha1(), 0
        row = {
            "page_id": _page(fields["warc-record-id"]),
            "url": fields.get("warc-target-uri"),
            "record_type": fields["warc-type"],
            "refers_to": _page(fields.get("warc-refers-to")),
            "payload_bytes": int(http["content-length"]) if revisit else stored,
            "declared": declared,
        }
        left = stored
        for part in stream.block(stored, size):
            digest.update(part)
            left -= len(part)
            yield row | {"chunk_no": number, "last": not left, "data": part, "digest": digest.hexdigest()}
            number += 1
        if not stored:
            shown = declared if revisit else digest.hexdigest()
            yield row | {"chunk_no": 0, "last": True, "data": b"", "digest": shown}


CHUNK_ROWS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, declared string, "
    "chunk_no int, last boolean, data binary, digest string"
)
_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("declared", pa.string()),
        ("chunk_no", pa.int32()),
        ("last", pa.bool_()),
        ("data", pa.binary()),
        ("digest", pa.string()),
    ]
)


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The chunk table of the listed archives; without ``payloads``, only last chunks and no bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                with store.open_input_stream(path, compression=None) as raw:
                    for row in records(raw):
                        if not payloads:
                            if not row["last"]:
                                continue
                            row["data"] = None
                        held.append(row)
                        size += 200 + len(row["data"] or b"")
                        if size >= 4_000_000:
                            yield pa.RecordBatch.from_pylist(held, _ARROW)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)

    count = archives.count()
    dealt = archives.select("path").repartition(max(1, min(count, 10_000)))
    return dealt.mapInArrow(read, CHUNK_ROWS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write a record per page and read the archives back: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    Every row gives one row, repeated ids included. A null html is an empty payload,
    a null url gives no target line, a null page_id an empty record name. An empty
    table writes no archive. A payload that reads back with another digest than its
    record declares is an error.
    """
    folder = shared_path(pages.sparkSession, "warc")
    archives = write_archives(chunks(with_revisits(pages)), folder)
    rows = read_archives(archives, folder, payloads=False).where("last")
    sound = F.when(F.col("digest") == F.col("declared"), F.col("digest")).otherwise(
        F.raise_error(F.concat(F.lit("damaged record: "), F.col("page_id").cast("string")))
    )
    return rows.select(
        "page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to"
    )

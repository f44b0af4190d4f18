"""WARC archives of web pages, and their reading as a table of record chunks.

Writing: digests and lengths come from Spark's own functions; equal payloads are found by grouping (digest, length)
pairs, never payloads; each task streams its records into archives of its own, one gzip member per record,
under names of its own attempt. The manifest lists the archives of the attempts that succeeded, so a task that runs
twice adds no record. Reading: each archive is inflated piece by piece, and a payload becomes rows (record, chunk number,
chunk) of at most CHUNK bytes with the length and the SHA-1 so far, so no record is held whole by the reader.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratlens.llm import shared

CHUNK, REVISIT_FROM, ARCHIVE = 64 << 10, 1000, 64 << 20
MANIFEST = "path string, n_records long"
CHUNKS = (
    "page_id long, record_type string, refers_to long, header_digest string, header_bytes long, chunk_no int, "
    "chunk binary, bytes_so_far long, sha1_so_far string, last boolean"
)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def header(row: dict, length: int) -> bytes:
    """Header block of a record; row: page_id, url, record_type, refers_to, payload_digest (hex), payload_bytes."""
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    url = "".join(c for c in row["url"] or "" if c > " ")
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_uri(row['page_id'])}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {row['payload_bytes']}", "Content-Type: application/http;msgtype=response",
    ]
    if row["record_type"] == "revisit":
        lines += [
            f"WARC-Refers-To: {_uri(row['refers_to'])}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join([*lines, f"Content-Length: {length}", "", ""]).encode()


def write_record(out: BinaryIO, row: dict, payload: memoryview, chunk: int = CHUNK) -> None:
    """One gzip member, compressed chunk by chunk. A revisit has no payload."""
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    out.write(squeeze.compress(header(row, len(_HTTP) + len(payload)) + _HTTP))
    for at in range(0, len(payload), chunk):
        out.write(squeeze.compress(payload[at : at + chunk]))
    out.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush())


def _inflated(source: BinaryIO, chunk: int) -> Iterator[bytes]:
    """The members of a gzip file as pieces of at most chunk bytes."""
    inflate, data = zlib.decompressobj(31), b""
    while True:
        data = data or source.read(chunk)
        if not data:
            return
        piece = inflate.decompress(data, chunk)
        data = inflate.unconsumed_tail
        if inflate.eof:
            data, inflate = inflate.unused_data, zlib.decompressobj(31)
        if piece:
            yield bytes(piece)


def read_chunks(source: BinaryIO, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of CHUNKS of one archive. A record without payload is one empty chunk."""
    pieces, held = _inflated(source, chunk), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    def until_blank() -> bytes:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("the archive ends within a header")
        block = bytes(held[:end])
        del held[: end + 4]
        return block

    while held or more():
        block = until_blank()
        fields = dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:])
        left = int(fields["Content-Length"]) - len(until_blank()) - 4
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        common = (
            _page(fields["WARC-Record-ID"]), fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), digest,
            int(fields["X-Payload-Length"]),
        )
        sha1, number, done = hashlib.sha1(usedforsecurity=False), 0, 0
        while True:
            while len(held) < min(left, chunk) and more():
                pass
            part = bytes(held[: min(left, chunk)])
            if len(part) < min(left, chunk):
                raise ValueError("the archive ends within a payload")
            del held[: len(part)]
            left, done = left - len(part), done + len(part)
            sha1.update(part)
            yield *common, number, part, done, sha1.hexdigest(), left == 0
            number += 1
            if not left:
                break
        while len(held) < 4 and more():
            pass
        if held[:4] != b"\r\n\r\n":
            raise ValueError("a record does not end with two line ends")
        del held[:4]


def _typed(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary, null for a revisit), payload_bytes, payload_digest, record_type and refers_to."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    narrow = rows.select("page_id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= REVISIT_FROM)
    groups = narrow.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
    groups = groups.where("n > 1 and newest is not null").drop("n")
    old = narrow.join(groups, ["payload_digest", "payload_bytes"]).where(~F.col("page_id").eqNullSafe(F.col("newest")))
    old = old.select(F.col("page_id").alias("old_id"), F.col("payload_digest").alias("old_digest"), "newest").distinct()
    joined = rows.join(old, F.col("page_id").eqNullSafe(F.col("old_id")) & (F.col("payload_digest") == F.col("old_digest")), "left")
    return joined.select(
        "page_id", "url", F.when(F.col("newest").isNull(), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(F.col("newest").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("newest").alias("refers_to"),
    )


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write pages (page_id, url, html) below path, a URI that driver and executors share; gives the manifest.

    Of equal payloads of at least REVISIT_FROM bytes the one with the largest page_id is the response, the others revisit it;
    equal rows with that page_id are all responses. A null html is an empty payload, a null url an empty
    field, a null page_id an empty name (such a page is never revisited). An archive is closed beyond
    archive_bytes. Other columns are ignored; an empty table gives an empty manifest.
    """
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(uri)
        files.create_dir(folder, recursive=True)
        out, name, records, manifest = None, "", 0, []
        for batch in batches:
            payloads = batch.column("payload")
            narrow = batch.drop_columns(["payload"]).to_pylist()
            for row, payload in zip(narrow, payloads, strict=True):
                if out is None:
                    name, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(name, compression=None)
                write_record(out, row, memoryview(payload.as_buffer() or b""))
                records += 1
                if out.tell() > archive_bytes:
                    out.close()
                    out = None
                    manifest.append((name, records))
        if out is not None:
            out.close()
            manifest.append((name, records))
        columns = list(zip(*manifest, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], ["path", "n_records"])

    return shared.table(_typed(pages).mapInArrow(write, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of all archives of a manifest."""
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    names = [field.split(" ")[0] for field in CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows, size = [], 0
                with files.open_input_stream(name, compression=None) as source:
                    for row in read_chunks(source, chunk):
                        rows.append(row)
                        size += len(row[6])
                        if size > 4 << 20 or len(rows) == 5000:
                            yield emit(rows)
                            rows, size = [], 0
                yield emit(rows)

    # A few archives a task, however the manifest's own files lie.
    tasks = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return manifest.repartition(int(tasks), "path").mapInArrow(read, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record, from its last chunk.

    A response whose chunks do not add up to the digest in its header fails the job.
    """
    intact = (F.col("record_type") == "revisit") | (
        (F.col("sha1_so_far") == F.col("header_digest")) & (F.col("bytes_so_far") == F.col("header_bytes"))
    )
    digest = F.when(intact, F.col("header_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), "page_id")))
    return chunks.where("last").select(
        "page_id", F.col("header_bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """records() of pages written to archives in the shared folder and read back."""
    path = shared.new_path(pages.sparkSession, "warc")
    return records(read_archives(write_archives(pages, path), path))

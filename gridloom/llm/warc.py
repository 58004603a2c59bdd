"""WARC archives: whole-stream gzip in, one gzip member per record out, with an offset index beside it.

1. ``write_monolithic``: each task writes its rows as archives that are one
   gzip stream each, and returns a row per record.
2. ``mark_revisits``: of records with equal payloads the smallest id stays a
   response. Only digests are shuffled, never payloads.
3. ``normalise``: each archive is inflated once, front to back; every record
   becomes a gzip member of its own, and offsets go to a sidecar index.
4. ``read_records``: opens members by their offsets and checks payloads
   against their digests.

Files get the task attempt's id in their names and are known only by the
table that the stage commits, so a lost executor leaves no half archive in
use.

Null html: empty payload. Null url: empty header. A null id is a response and
never the first of its group. Rows with one id and equal payloads are all
responses when that id is the group's smallest. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import drop_staged, open_fs, scratch_path, shuffle_partitions, stage

MIN_REVISIT_BYTES = 100
WRITTEN = "file string, seq long, page_id long, payload_bytes long, payload_digest string"
MEMBERS = "file string, page_id long, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC/1.0 record; a revisit has no payload but keeps its size and digest."""
    head = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = b"" if revisit else payload
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def read_record(stream) -> tuple[dict[str, str], bytes] | None:
    """The next record's headers and body, None at the end."""
    line = stream.readline()
    if not line:
        return None
    if line.rstrip() != b"WARC/1.0":
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    headers = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().partition(":")
        headers[name.strip()] = value.strip()
    body = stream.read(n := int(headers["Content-Length"]))
    if len(body) != n or stream.read(4) != b"\r\n\r\n":
        raise ValueError("a WARC record ends early")
    return headers, body


def _id(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def write_monolithic(pages: DataFrame, folder: str, archive_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """Archives of about ``archive_bytes`` of payload, each a single gzip stream; a row per record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        task, n, out, zipped, size, seq = TaskContext.get().taskAttemptId(), 0, None, None, 0, 0

        def close():
            if zipped is not None:
                zipped.close()
                out.close()

        for batch in batches:
            rows = []
            for page_id, url, html in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["html"].cast(pa.binary()).to_pylist(), strict=True):
                if zipped is None or size >= archive_bytes:
                    close()
                    name, size, seq, n = f"a{task}-{n:05d}.warc.gz", 0, 0, n + 1
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    zipped = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=level, mtime=0)
                payload = html or b""
                digest = hashlib.sha256(payload).hexdigest()
                zipped.write(record_bytes(page_id, url, payload, digest))
                rows.append((name, seq, page_id, len(payload), digest))
                size, seq = size + len(payload), seq + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())], names=["file", "seq", "page_id", "payload_bytes", "payload_digest"])
        close()

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(write, WRITTEN)


def mark_revisits(written: DataFrame) -> DataFrame:
    """``written`` with refers_to: the smallest id of those with the same payload, null for a response."""
    first = written.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("payload_digest", "first_id")
    return written.join(first, "payload_digest", "left").select("file", "seq", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id")).alias("refers_to"))


def normalise(marked: DataFrame, source: str, target: str, level: int = 1) -> DataFrame:
    """Rewrite every archive of ``marked`` (file, seq, refers_to) with a gzip member per record, and a sidecar index."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, src = open_fs(source)
        out_fs, dst = open_fs(target)
        out_fs.create_dir(dst, recursive=True)
        task, now, stream, out, side, at = TaskContext.get().taskAttemptId(), None, None, None, None, 0

        def close():
            if now is not None:
                if read_record(stream) is not None:
                    raise ValueError(f"{now} has records that are not in the table")
                for x in (stream, out, side):
                    x.close()

        for batch in batches:
            rows = []
            for file, refers_to in zip(batch["file"].to_pylist(), batch["refers_to"].to_pylist(), strict=True):
                if file != now:
                    close()
                    now, at, name = file, 0, f"{file.removesuffix('.warc.gz')}-n{task}.warc.gz"
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=fs.open_input_stream(f"{src}/{file}", compression=None)), 1 << 20)
                    out, side = out_fs.open_output_stream(f"{dst}/{name}", compression=None), out_fs.open_output_stream(f"{dst}/{name}.index")
                headers, payload = read_record(stream)
                page_id = _id(headers["WARC-Record-ID"])
                member = gzip.compress(record_bytes(page_id, headers["WARC-Target-URI"], payload, headers["WARC-Payload-Digest"].removeprefix("sha256:"), refers_to, refers_to is not None), level, mtime=0)
                out.write(member)
                side.write((json.dumps({"page_id": page_id, "offset": at, "length": len(member)}) + "\n").encode())
                rows.append((name, page_id, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["file", "page_id", "offset", "length"])
        close()

    n = shuffle_partitions(marked.sparkSession)
    return marked.repartition(n, "file").sortWithinPartitions("file", "seq").select("file", "refers_to").mapInArrow(rewrite, MEMBERS)


def read_records(members: DataFrame, folder: str) -> DataFrame:
    """The records at (file, offset, length), each read by itself and checked against its digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        now, handle = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(batch["file"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist(), strict=True):
                if file != now:
                    if handle is not None:
                        handle.close()
                    now, handle = file, fs.open_input_file(f"{base}/{file}")
                handle.seek(offset)
                headers, body = read_record(io.BytesIO(gzip.decompress(handle.read(length))))
                digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"]
                if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                    raise ValueError(f"{file} at {offset}: the payload has another digest")
                rows.append((_id(headers["WARC-Record-ID"]), int(headers["X-Payload-Length"]), digest, kind, _id(headers["WARC-Refers-To"]) if kind == "revisit" else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if handle is not None:
            handle.close()

    n = shuffle_partitions(members.sparkSession)
    return members.repartition(n, "file").sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(read, RECORDS)


def archive(pages: DataFrame, folder: str | None = None, archive_bytes: int = 4 << 20) -> tuple[DataFrame, str]:
    """Write, normalise and index ``pages`` (page_id, url, html); the member table and the archives' folder."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    whole, single = f"{folder}/whole", f"{folder}/members"
    written = stage(write_monolithic(pages, whole, archive_bytes), "warc-written")
    members = stage(normalise(mark_revisits(written), whole, single), "warc-members")
    drop_staged(written)
    fs, path = open_fs(whole)
    if fs.get_file_info(path).type.name == "Directory":
        fs.delete_dir(path)
    return members, single

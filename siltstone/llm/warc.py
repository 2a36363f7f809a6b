"""Operator 10: WARC archives from pages, normalised to a gzip member for each record, with an offset index.

1. Payload digests are compared by a plain aggregate; of equal payloads the smallest page_id stays a response, the others
   become revisits.  Only ids of revisits are joined back to the pages: payloads aren't shuffled.
2. Each task writes its pages as one archive in one gzip stream.
3. The normaliser inflates a whole archive once, as a stream, and writes each record as a member of its own and a sidecar of
   one line a record (offset, length, type, id).
4. The reader seeks each record by the sidecar and inflates that member alone.

Files go to the shared folder under names of the task's attempt; only names that a successful attempt returned are read
on, so a lost executor leaves nothing but unread files.

A null html is an empty payload, a null page_id makes a response without number, rows with equal page_id and payload are
alike.  An empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.storage import Workspace


@dataclass(frozen=True)
class WarcConfig:
    """Payloads of fewer than ``min_bytes`` are always responses."""

    min_bytes: int = 0
    stream_level: int = 1
    member_level: int = 6
    chunk: int = 1 << 20
    broadcast_rows: int = 1_000_000
    date: str = "2020-01-01T00:00:00Z"


_GZIP = 31
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else "<urn:page:none>"


def page_of(found: str | None) -> int | None:
    name = (found or "").strip("<>").rpartition(":")[2]
    return int(name) if name.lstrip("-").isdigit() else None


def make_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """A response, or with ``first`` a revisit of that page: its block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if first is not None:
        lines += [f"WARC-Refers-To: {record_id(first)}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def _open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def inflate(stream, chunk: int) -> Iterator[bytes]:
    """The content of a gzip file, of one member or several, in pieces."""
    z = zlib.decompressobj(_GZIP)
    while data := stream.read(chunk):
        while data:
            out = z.decompress(data, chunk)
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(_GZIP)
    if out := z.flush():
        yield out


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and whole bytes of each record of an inflated stream."""
    have = bytearray()

    def fill() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        have.extend(piece)
        return True

    while True:
        while (end := have.find(b"\r\n\r\n")) < 0:
            if not fill():
                if have.strip():
                    raise ValueError("the archive ends within a header")
                return
        fields = parse_header(bytes(have[:end]))
        size = end + 4 + int(fields["content-length"]) + 4
        while len(have) < size:
            if not fill():
                raise ValueError("the archive ends within a record")
        yield fields, bytes(have[:size])
        del have[:size]


def write_batches(root: str, cfg: WarcConfig):
    """A mapInArrow function: (page_id, url, html, first) to the path of one archive of one gzip stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        path = f"{root}/stream-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        out, z, n = None, zlib.compressobj(cfg.stream_level, zlib.DEFLATED, _GZIP), 0
        for batch in batches:
            for page, url, html, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    system, at = _open_fs(path)
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(at, compression=None)
                if data := z.compress(make_record(page, url, (html or "").encode(), first, cfg.date)):
                    out.write(data)
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return run


def normalise_batches(cfg: WarcConfig):
    """A mapInArrow function: (path) to (path, index, records) of the archive with a member for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = _open_fs(path)
                made = at.removesuffix(".warc.gz") + f"-members-{attempt}.warc.gz"
                offset = n = 0
                with system.open_input_stream(at, compression=None) as stream, system.open_output_stream(made, compression=None) as out, system.open_output_stream(made + ".idx", compression=None) as index:
                    for fields, raw in split_records(inflate(stream, cfg.chunk)):
                        member = zlib.compress(raw, cfg.member_level, _GZIP)
                        out.write(member)
                        index.write((json.dumps({"offset": offset, "length": len(member), "type": fields.get("warc-type"), "id": fields.get("warc-record-id")}) + "\n").encode())
                        offset, n = offset + len(member), n + 1
                new = path[: len(path) - len(at)] + made if path.endswith(at) else made
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([new + ".idx"]), pa.array([n], pa.int64())], names=["path", "index", "records"])

    return run


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function: (path, index) to one row for each record, read member by member."""
    for batch in batches:
        for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            system, at = _open_fs(path)
            with system.open_input_stream(_open_fs(index)[1], compression=None) as stream:
                entries = [json.loads(line) for line in stream.read().splitlines()]
            rows: list[list] = [[], [], [], [], []]
            with system.open_input_file(at) as archive:
                for e in entries:
                    raw = zlib.decompress(archive.read_at(e["length"], e["offset"]), _GZIP)
                    end = raw.index(b"\r\n\r\n")
                    fields = parse_header(raw[:end])
                    block = raw[end + 4 : end + 4 + int(fields["content-length"])]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if fields["warc-type"] == "response":
                        size, digest = len(payload), digest_of(payload)
                        if f"sha1:{digest}" != fields["warc-payload-digest"]:
                            raise ValueError(f"{path} at {e['offset']}: the payload doesn't match its digest")
                    else:
                        size, digest = int(http.lower().partition(b"content-length:")[2].split(b"\r\n")[0]), fields["warc-payload-digest"].removeprefix("sha1:")
                    refers = page_of(fields.get("warc-refers-to")) if fields["warc-type"] == "revisit" else None
                    for x, v in zip(rows, (page_of(fields["warc-record-id"]), size, digest, fields["warc-type"], refers), strict=True):
                        x.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def write_archives(spark: SparkSession, pages: DataFrame, cfg: WarcConfig = WarcConfig(), root: str | None = None) -> DataFrame:
    """Writes and normalises archives under ``root`` (the shared folder by default): (path, index, records)."""
    ws = Workspace(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    ids = rows.where(F.col("page_id").isNotNull() & (size >= cfg.min_bytes)).select("page_id", "digest")
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = ws.save(ids.join(firsts, "digest").where("page_id <> first").distinct(), "revisits")
    few = again.count() <= cfg.broadcast_rows
    written = rows.join(F.broadcast(again) if few else again, ["page_id", "digest"], "left").select("page_id", "url", "html", "first")
    streams = ws.save(written.mapInArrow(write_batches(root or f"{ws.root}/archives", cfg), "path string, records long"), "streams")
    tasks = max(1, min(streams.count(), 10_000))
    return ws.save(streams.select("path").repartition(tasks, "path").mapInArrow(normalise_batches(cfg), "path string, index string, records long"), "members")


def read_archives(archives: DataFrame, tasks: int) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records of ``archives(path, index)``."""
    return archives.select("path", "index").repartition(tasks, "path").mapInArrow(read_batches, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: writes all pages, reads all archives back."""
    archives = write_archives(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(archives, max(1, min(archives.count(), 10_000)))

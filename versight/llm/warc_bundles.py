"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames followed by a seek table in a
skippable frame (magic 0x184D2A5E; for each frame its compressed and decompressed size;
then the number of frames, a descriptor and the magic 0x8F92EAB1), as in the public
seekable format. Any Zstandard reader can read the whole file, and one frame can be read
alone. Records are grouped into frames of about ``frame_bytes``, and the index maps each
record to (bundle, frame, offset in the decompressed frame, length).

Of records with equal payloads one kind is stored: those with the largest id are
``response`` records, the others are ``revisit`` records that name it. The largest id of a
payload is found by an aggregate on the payload's digest that shuffles digests and ids
only. The table of repeated digests is broadcast when it has ``BROADCAST_ROWS`` rows at most
(it is counted); beyond that rows are joined to it by a shuffle in which adaptive execution
splits the rows of a frequent payload, since the table has one row for it.

Bundles are written by the tasks to a folder that all executors share, under a name of
their own for each attempt; the name is part of the index, so only files of attempts that
Spark has counted are read. A lost executor costs its running tasks; files of failed
attempts are never referred to.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from versight.llm.shared import scratch, written

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
BROADCAST_ROWS = 100_000
#: Bytes of records that one reading task takes.
TASK_BYTES = 32 << 20
RECORD = "record_id string, bundle string, frame int, offset long, length long"


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1, without a label."""
    return base64.b32encode(sha1(payload).digest()).decode("ascii")


def record_of(record_id: str, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that refers to one."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(size).encode() + b"\r\n\r\n" + body
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-record:{record_id}>", "WARC-Date: 2000-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Target-URI: {clean}"] if clean else []
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-record:{refers_to}>"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-cased names), HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's end is missing")
    http, _, payload = block.partition(b"\r\n\r\n")
    http_fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:])}
    return {"fields": fields, "http": http_fields, "payload": payload}


def _open(path: str):
    """(file system, path) of a file: or other URI that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(path: str) -> list[tuple[int, int, int]]:
    """(place in the file, compressed size, decompressed size) of each frame."""
    system, at = _open(path)
    with system.open_input_file(at) as f:
        size = f.size()
        n, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        width = 12 if flags & 0x80 else 8
        body = f.read_at(n * width, size - 9 - n * width)
    out, place = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", body, i * width)
        out.append((place, packed, plain))
        place += packed
    return out


def read_frame(path: str, frame: tuple[int, int, int]) -> bytes:
    import zstandard

    system, at = _open(path)
    with system.open_input_file(at) as f:
        return zstandard.ZstdDecompressor().decompress(f.read_at(frame[1], frame[0]), max_output_size=frame[2])


class BundleWriter:
    """Writes records to one file, a frame at a time; memory is one frame."""

    def __init__(self, path: str, frame_bytes: int, level: int = 3):
        import zstandard

        system, at = _open(path)
        system.create_dir(at.rpartition("/")[0], recursive=True)
        self.out, self.pack, self.limit = system.open_output_stream(at, compression=None), zstandard.ZstdCompressor(level=level), frame_bytes
        self.parts: list[bytes] = []
        self.filled, self.size, self.sizes = 0, 0, []

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset in it, length) of the record. A record longer than a frame has one of its own."""
        if self.parts and self.filled + len(record) > self.limit:
            self.flush()
        place = (len(self.sizes), self.filled, len(record))
        self.parts.append(record)
        self.filled += len(record)
        return place

    def flush(self) -> None:
        packed = self.pack.compress(b"".join(self.parts))
        self.out.write(packed)
        self.size += len(packed)
        self.sizes.append((len(packed), self.filled))
        self.parts, self.filled = [], 0

    def close(self) -> None:
        if self.parts:
            self.flush()
        self.out.write(seek_table(self.sizes))
        self.out.close()


def write_bundles(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20) -> DataFrame:
    """Writes all rows as records below ``folder``; returns the index, one row per record.

    Columns: record_id, bundle, frame, offset, length. Records with equal payloads of at
    least ``least`` bytes are responses where their id is the largest (all such rows, if
    rows repeat), else revisits of it. Null payloads are empty; a null id is written as
    ``null`` and counts as smaller than all others; null urls are left out. An empty table
    gives an empty index and no file.
    """
    digest = F.unhex(F.sha1(F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")))
    repeated = pages.select(F.col(id_col).alias("_id"), digest.alias("_d")).groupBy("_d").agg(F.max("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_d", "_first")
    repeated = written(repeated, "repeated")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(payload_col).alias("_p"), digest.alias("_d"))
    few = repeated.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(repeated) if few else repeated, "_d", "left").select("_id", "_url", "_p", F.when(F.octet_length(F.coalesce("_p", F.lit(""))) >= least, F.col("_first")).alias("_first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = writer = None
        for batch in batches:
            out = []
            for key, url, text, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    bundle = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(bundle, frame_bytes)
                payload = (text or "").encode("utf-8", "surrogatepass")
                revisit = first is not None and key != first
                record_id = "null" if key is None else str(key)
                record = record_of(record_id, url, payload, digest_of(payload), len(payload), str(first) if revisit else None)
                out.append((record_id, bundle, *writer.add(record)))
                if writer.size >= bundle_bytes:
                    writer.close()
                    writer = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["record_id", "bundle", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    return written(rows.mapInArrow(write, RECORD), "warc-index")


def read_bundles(index: DataFrame) -> DataFrame:
    """One row per record of the bundles named in ``index``, read through seek tables and frames.

    Columns: record_id, record_type, refers_to, url, payload_bytes, payload_digest,
    payload (null for revisits). A response's digest and length are computed from what was
    read and must equal those in its headers. Each frame is read once, by one task; the
    number of tasks follows the bytes of the records, since the index itself is small.
    """
    total, n_frames = index.agg(F.sum("length"), F.count_distinct("bundle", "frame")).first()
    tasks = max(1, min(n_frames, -(-(total or 0) // TASK_BYTES)))
    frames = index.repartition(tasks, "bundle", "frame").groupBy("bundle", "frame").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, list] = {}
        for batch in batches:
            for bundle, frame, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle not in tables:
                    if len(tables) > 64:
                        tables.clear()
                    tables[bundle] = read_seek_table(bundle)
                plain, out = read_frame(bundle, tables[bundle][frame]), []
                for x in records:
                    r = parse_record(plain[x["offset"] : x["offset"] + x["length"]])
                    fields = r["fields"]
                    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(r["http"]["content-length"])
                    stored = fields["warc-type"] == "response"
                    if stored and (digest_of(r["payload"]), len(r["payload"])) != (digest, size):
                        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
                    name = lambda v: v and v.removeprefix("<urn:x-record:").removesuffix(">")
                    out.append((name(fields["warc-record-id"]), fields["warc-type"], name(fields.get("warc-refers-to")), fields.get("warc-target-uri"), size, digest, r["payload"] if stored else None))
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["record_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest", "payload"])

    return frames.mapInArrow(read, "record_id string, record_type string, refers_to string, url string, payload_bytes long, payload_digest string, payload binary")


def read_record(bundle: str, frame: int, offset: int, length: int) -> dict:
    """One record by its place in the index: one seek, one frame."""
    return parse_record(read_frame(bundle, read_seek_table(bundle)[frame])[offset : offset + length])


def archive_folder(spark) -> str:
    return scratch(spark, "warc")

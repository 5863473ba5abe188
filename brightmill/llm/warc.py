"""Dictionary-compressed WARC writer (.warc.zst).

Each output file starts with a skippable Zstandard frame (magic 0x184D2A5D) that holds the file's
dictionary; after it every WARC record is one Zstandard frame compressed with that dictionary, so any
record can be read alone from its offset. The dictionary is built from all records of its file, so it needs no
global step: every task writes the files of its own partition, in pieces of about ``file_bytes`` of
records. Where records are too few or too small to train on, the dictionary is raw content: the beginnings of all of them.

Files go to a folder that all executors share. A file is written under a name of its task attempt and
renamed when complete, so a repeated or speculative task leaves the same file. The manifest (one row per
record) is stored beside the files.

Defined results: a NULL html gives a record with an empty body; a NULL url is written as
``urn:null``; line breaks and blanks inside URLs are percent-encoded; a NULL page_id is carried in the manifest; repeated
rows give repeated records with different record ids; a page larger than ``limit`` closes its file, so a task holds one
file and one page (pages end at 2 GB, where Spark's strings do); an empty table gives no files and an empty
manifest; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import scratch
from ._text import rebatch

MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 112_640
FILE_BYTES = 32 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
_MANIFEST = "page_id {0}, warc_file string, record_no int, offset bigint, length bigint, payload_bytes bigint, payload_digest string"


def record(url: str | None, body: bytes, number: str, date: str = DATE) -> tuple[bytes, str]:
    """A WARC resource record and its payload digest."""
    target = "urn:null" if url is None else "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) if b < 128 else f"%{b:02X}" for b in url.encode())
    digest = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    name = uuid.UUID(bytes=hashlib.md5(f"{number}|{target}|{digest}".encode()).digest(), version=4)
    head = (
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Target-URI: {target}\r\nWARC-Date: {date}\r\n"
        f"WARC-Block-Digest: {digest}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + body + b"\r\n\r\n", digest


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from all the records: trained (on every position of every record), or else the beginnings of the
    records as raw content."""
    most = min(size, max(1024, sum(map(len, records)) // 10))
    try:
        return zstandard.train_dictionary(most, records, k=512, d=8, f=20, accel=1, level=LEVEL, notifications=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r[: max(16, most // len(records))] for r in records)[:most]


def file_bytes(records: list[bytes]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes of a file and (offset, length) of every record's frame."""
    raw = dictionary(records)
    out = [struct.pack("<II", MAGIC, len(raw)) + raw]
    compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(raw)).compress
    at, where = len(out[0]), []
    for r in records:
        frame = compress(r)
        where.append((at, len(frame)))
        at += len(frame)
        out.append(frame)
    return b"".join(out), where


def read_file(data: bytes) -> list[bytes]:
    """The records of a file."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no leading dictionary frame")
    words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    rest, out = data[8 + size :], []
    while rest:
        d = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
        out.append(d.decompress(rest))
        rest = d.unused_data
    return out


def write(pages: DataFrame, path: str | None = None, limit: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Write all pages below ``path`` (by default a new place in the shared folder) and return the manifest."""
    spark = pages.sparkSession
    path = (path or scratch(spark, "warc")).rstrip("/")
    schema = _MANIFEST.format(pages.schema["page_id"].dataType.simpleString())

    def run(batches):
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        system, root = pafs.FileSystem.from_uri(path)
        number, ids, records, digests, sizes, held = 0, [], [], [], [], 0

        def flush():
            name = f"part-{part:05d}-{number:05d}.warc.zst"
            data, where = file_bytes(records)
            system.create_dir(root, recursive=True)
            own = f"{root}/.{name}.{attempt}"
            with system.open_output_stream(own) as f:
                f.write(data)
            system.move(own, f"{root}/{name}")
            n = len(records)
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.array([name] * n), pa.array(range(n), pa.int32()), pa.array([a for a, _ in where], pa.int64()), pa.array([b for _, b in where], pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                names=["page_id", "warc_file", "record_no", "offset", "length", "payload_bytes", "payload_digest"],
            )

        seen = 0
        for batch in rebatch(batches, 512, min(limit, 4 << 20)):
            ids.append(batch.column(0))
            for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                body = (html or "").encode()
                data, digest = record(url, body, f"{part}-{seen}", date)
                seen += 1
                records.append(data), digests.append(digest), sizes.append(len(body))
                held += len(data)
            if held >= limit:
                yield flush()
                number += 1
                ids, records, digests, sizes, held = [], [], [], [], 0
        if records:
            yield flush()

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, schema)
    rows.write.parquet(f"{path}/_manifest")
    return spark.read.schema(rows.schema).parquet(f"{path}/_manifest")

"""Seekable Zstandard bundles of WARC records.

Records are grouped into independent Zstandard frames, and a bundle ends with a seek table in a skippable frame
(the public seekable format), so any reader of .zst files reads the whole and a seeking
reader decompresses the one frame that a record lies in. Bundles are written by Spark as rows whose
``data`` is the whole file, which makes a lost executor's bundles come back through Spark's own commit
protocol on any store that Spark can write to. An index maps record identifiers to frames and offsets.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Fixed values of the seekable format and of WARC 1.1.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES = 128 << 10
BUNDLE_BYTES = 4 << 20
LEAST_REVISIT = 100
SALTS = 16
BUNDLE_SCHEMA = (
    "bundle string, data binary, n_frames int, n_records long,"
    " index array<struct<record_id: string, frame: int, offset: long, length: long>>"
)


def record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def make_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response with its payload, or a revisit that names the response instead of repeating it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers, HTTP length and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return {"fields": fields, "payload": payload, "payload_bytes": int(declared["Content-Length"])}


class BundleWriter:
    """Collects records into frames; ``close`` returns the file and its index. Holds one bundle at most."""

    def __init__(self, frame_bytes: int, level: int = 3):
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frame_bytes = frame_bytes
        self.frames: list[bytes] = []
        self.sizes: list[int] = []
        self.open: list[bytes] = []
        self.open_bytes = self.total = 0
        self.index: list[dict] = []

    def add(self, name: str, record: bytes) -> None:
        if self.open and self.open_bytes + len(record) > self.frame_bytes:
            self._end_frame()
        self.index.append({"record_id": name, "frame": len(self.frames), "offset": self.open_bytes, "length": len(record)})
        self.open.append(record)
        self.open_bytes += len(record)
        self.total += len(record)

    def _end_frame(self) -> None:
        if self.open:
            self.frames.append(self.compressor.compress(b"".join(self.open)))
            self.sizes.append(self.open_bytes)
            self.open, self.open_bytes = [], 0

    def close(self) -> tuple[bytes, int, list[dict]]:
        self._end_frame()
        entries = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self.sizes, strict=True))
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        table = struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer
        return b"".join(self.frames) + table, len(self.frames), self.index


class BundleReader:
    """Seeks by the footer's table: only the frames that are asked for are decompressed."""

    def __init__(self, data: bytes):
        n, descriptor, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        width = 12 if descriptor & 0x80 else 8
        at = len(data) - 9 - n * width
        kind, length = struct.unpack("<II", data[at - 8 : at])
        if kind != SKIPPABLE_MAGIC or length != n * width + 9:
            raise ValueError("damaged seek table")
        self.data, self.places, begin = data, [], 0
        for k in range(n):
            packed, size = struct.unpack("<II", data[at + k * width : at + k * width + 8])
            self.places.append((begin, packed, size))
            begin += packed
        self.decompressor = zstandard.ZstdDecompressor()
        self.held: tuple[int, bytes] = (-1, b"")

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if self.held[0] != frame:
            begin, packed, size = self.places[frame]
            self.held = (frame, self.decompressor.decompress(self.data[begin : begin + packed], max_output_size=size))
        return self.held[1][offset : offset + length]


def _write(frame_bytes: int, bundle_bytes: int):
    kinds = to_arrow_schema(T.StructType.fromDDL(BUNDLE_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(w: BundleWriter) -> pa.RecordBatch:
            data, frames, index = w.close()
            name = f"bundle-{hashlib.sha256(data).hexdigest()[:24]}.warc.zst"
            values = ([name], [data], [frames], [len(index)], [index])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, kinds, strict=True)], names=kinds.names)

        writer = BundleWriter(frame_bytes)
        for batch in batches:
            for r in batch.to_pylist():
                record = make_record(r["page_id"], r["url"], r["html"].encode("utf-8", "replace"), r["digest"], r["refers_to"])
                writer.add(record_id(r["page_id"]), record)
                if writer.total >= bundle_bytes:
                    yield row(writer)
                    writer = BundleWriter(frame_bytes)
        if writer.index:
            yield row(writer)

    return run


def bundles(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
    frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """One row per bundle: name, file, frames, records and index. Write it as Parquet; it is the archive.

    Of equal payloads of ``LEAST_REVISIT`` bytes or more the smallest page_id is the response, also if several rows
    repeat it, and all others are revisits of it. Null payloads are empty; null ids are never the response of a group
    with an id, and a group of null ids holds responses only. Only counts and ids of repeated payloads are joined, spread over salts.
    """
    body = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"),
    )
    own = body.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    repeated = own.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1 and first is not null")
    repeated = repeated.select(
        F.col("digest").alias("__digest"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    )
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    joined = own.withColumn("salt", salt).join(
        repeated, (F.col("digest") == F.col("__digest")) & (F.col("salt") == F.col("__salt")), "left"
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return rows.mapInArrow(_write(frame_bytes, bundle_bytes), BUNDLE_SCHEMA)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for data, index in zip(batch["data"], batch["index"], strict=True):
            reader, rows = BundleReader(bytes(data)), []
            for place in index:
                got = parse_record(reader.read(place["frame"], place["offset"], place["length"]))
                fields, payload = got["fields"], got["payload"]
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != got["payload_bytes"]):
                    raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                rows.append((
                    fields["WARC-Record-ID"], kind, got["payload_bytes"], digest, fields.get("WARC-Refers-To"),
                    fields["WARC-Target-URI"], payload if kind == "response" else None,
                ))
            yield pd.DataFrame(rows, columns=["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload"])


def records(archive: DataFrame) -> DataFrame:
    """Every record of the bundles, read through seek table and index; responses' digests are checked."""
    schema = (
        "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, url string, payload binary"
    )
    return archive.select("data", "index").mapInPandas(_read, schema)


def index(archive: DataFrame) -> DataFrame:
    """(record_id, bundle, frame, offset, length): where every record lies; offsets are relative to the frame."""
    return archive.select("bundle", F.explode("index").alias("i")).select("i.record_id", "bundle", "i.frame", "i.offset", "i.length")

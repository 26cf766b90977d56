"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``FRAME_BYTES``; a bundle is a file of frames that ends
with a seek table (a skippable frame: compressed and plain size of every frame, then the number of frames and the
magic number of the seekable format), so any frame can be read alone and a plain ``zstd -d`` still reads the whole file. The
index maps each record id to its bundle, frame and offset inside the plain frame. Bundles are written by the tasks under
fresh names; only those named in the index count, so a task that runs again leaves nothing wrong behind.

Of equal payloads (same SHA-1 and length) the row with the smallest ``page_id`` is a response record, all others are
revisits of it, empty payloads included; smaller payloads than ``least`` are all responses. Null html counts as empty.
Rows with equal payload and equal ``page_id`` are the same record and all of its type; a row without ``page_id`` is written
with an empty id and sorts after all ids. Carriage returns and line ends in a url are dropped. An empty table gives no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import utf8, written
from tidemark.session import scratch_dir

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit carries the HTTP headers, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "").replace("\n", ""))
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    body = http if revisit else http + payload
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(frame: bytes, at: int) -> tuple[dict, int]:
    """The record at an offset of a plain frame, and where the next begins."""
    head_end = frame.index(b"\r\n\r\n", at)
    first, *lines = frame[at:head_end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at offset {at}")
    heads = dict(line.split(": ", 1) for line in lines)
    begin, size = head_end + 4, int(heads["Content-Length"])
    body = frame[begin : begin + size]
    http_end = body.index(b"\r\n\r\n") + 4
    stated = next(int(x[16:]) for x in body[:http_end].split(b"\r\n") if x.startswith(b"Content-Length: "))
    revisit, payload = heads["WARC-Type"] == "revisit", body[http_end:]
    digest = heads["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != stated or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {heads['WARC-Record-ID']}")

    def page(value: str) -> int | None:
        return int(value) if (value := value.removeprefix("<urn:page:").removesuffix(">")) else None

    out = {
        "page_id": page(heads["WARC-Record-ID"]), "payload_bytes": stated, "payload_digest": digest, "record_type": heads["WARC-Type"],
        "refers_to": page(heads["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }
    return out, begin + size + 4


class BundleWriter:
    """Collects records into frames and frames into one file; ``close`` gives the index rows."""

    def __init__(self, folder: str, frame_bytes: int):
        self.path = f"{folder}/{os.urandom(12).hex()}.warc.zst"
        self.files, path = pafs.FileSystem.from_uri(self.path)
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.frame_bytes = self.files.open_output_stream(path, compression=None), frame_bytes
        self.zstd, self.open, self.sizes, self.index, self.size = zstandard.ZstdCompressor(level=3), [], [], [], 0
        self.filled = 0

    def add(self, page_id: int | None, data: bytes) -> None:
        self.index.append((page_id, self.path, len(self.sizes), self.filled, len(data)))
        self.open.append(data)
        self.filled += len(data)
        if self.filled >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            packed = self.zstd.compress(b"".join(self.open))
            self.out.write(packed)
            self.sizes.append((len(packed), self.filled))
            self.size, self.open, self.filled = self.size + len(packed), [], 0

    def close(self) -> list[tuple]:
        self.end_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        return self.index


class BundleReader:
    def __init__(self, path: str):
        files, inner = pafs.FileSystem.from_uri(path)
        self.file = files.open_input_file(inner)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table in {path}")
        table = struct.unpack(f"<{2 * count}I", self.file.read_at(8 * count, size - 9 - 8 * count))
        self.plain, self.at = table[1::2], [0]
        for packed in table[::2]:
            self.at.append(self.at[-1] + packed)

    def frame(self, number: int) -> bytes:
        packed = self.file.read_at(self.at[number + 1] - self.at[number], self.at[number])
        return zstandard.ZstdDecompressor().decompress(packed, max_output_size=self.plain[number])


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to, revisit) of every page."""
    payload = utf8("html")
    known = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("size"))
    firsts = known.groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    revisit = (F.col("size") >= least) & (F.col("copies") > 1) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return known.join(firsts, ["sha1", "size"]).select("page_id", "url", "payload", "sha1", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_bundles(pages: DataFrame, folder: str, least: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write every page's record below ``folder``; the index, kept as a table in the shared folder."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, done = None, []
        for batch in batches:
            for r in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "sha1", "refers_to", "revisit")), strict=True):
                page_id, url, payload, sha1, refers_to, revisit = (x.as_py() for x in r)
                bundle = bundle or BundleWriter(folder, frame_bytes)
                bundle.add(page_id, record(page_id, url, payload, base32(sha1), refers_to, revisit))
                if bundle.size >= bundle_bytes:
                    done, bundle = done + bundle.close(), None
            if bundle is None and done:
                yield _rows(done, INDEX)
                done = []
        if bundle is not None:
            done += bundle.close()
        if done:
            yield _rows(done, INDEX)

    return written(typed(pages, least).mapInArrow(step, INDEX), "warc-index")


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def read_records(wanted: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at these rows of an index; each frame is read and unpacked once, by one task."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple[str, BundleReader] | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if open_ is None or open_[0] != row["bundle"]:
                    open_ = row["bundle"], BundleReader(row["bundle"])
                frame = open_[1].frame(row["frame"])
                found = [parsed(frame, at)[0] for at in row["offsets"]]
                yield _rows([(*list(r.values())[:5], r["payload"] if payloads else None) for r in found], RECORD)

    frames = wanted.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    return frames.mapInArrow(step, RECORD)


def op9_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_dir(spark, "warc"))
    return read_records(index, payloads=False).drop("payload")


QUERIES = {"op9_warc_bundles": op9_warc_bundles}
SQL: dict[str, str] = {}

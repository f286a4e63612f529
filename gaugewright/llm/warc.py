"""WARC records in seekable Zstandard bundles.

Records are grouped into frames of about ``frame_bytes``, each compressed on its own; a bundle ends with
the seek table of the public seekable format (a skippable frame with the sizes of all frames), so any
frame can be read alone and any Zstandard reader can read the whole. An index table maps record
identifiers to bundle, frame, and the offset inside the frame.

Bundles go to the shared folder under names that no other attempt uses; only those that the index names
count, so tasks can be repeated. Of pages with equal payloads of at least ``revisit_bytes`` bytes, the one with the
largest identifier is a response and the others are revisits that refer to it.

Cases: a null html is an empty payload; a null url leaves out the target header; pages with a null
identifier are responses; rows repeated with identifier and html that hold the largest identifier are
all responses; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.session import materialize, new_path

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def page_of(identifier: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", identifier or "")
    return int(found[1]) if found else None


def make_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record: a response with HTTP headers and payload, or a revisit with HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def parse_records(frame: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of each record of a frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        headers = parse_headers(frame[at:end])
        start, size = end + 4, int(headers["content-length"])
        yield at, headers, frame[start : start + size]
        at = start + size + 4


def read_back(headers: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """Page, payload bytes, digest, type, page referred to, and payload of a parsed record; a response is checked."""
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(parse_headers(http)["content-length"])
    page = page_of(headers["warc-record-id"])
    if headers["warc-type"] == "revisit":
        return page, size, digest, "revisit", page_of(headers.get("warc-refers-to")), None
    if len(payload) != size or payload_digest(payload) != digest:
        raise ValueError(f"record {headers['warc-record-id']} doesn't have the payload that its headers state")
    return page, size, digest, "response", None, payload


class BundleWriter:
    """Collects records into frames and frames into one file."""

    def __init__(self, file, frame_bytes: int):
        import zstandard

        self.file, self.frame_bytes, self.written = file, frame_bytes, 0
        self.compress = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        self.buffer, self.sizes = bytearray(), []

    def add(self, record: bytes) -> tuple[int, int]:
        """The record's frame number and its offset there."""
        if self.buffer and len(self.buffer) + len(record) > self.frame_bytes:
            self._flush()
        at = len(self.sizes), len(self.buffer)
        self.buffer += record
        return at

    def _flush(self) -> None:
        packed = self.compress(bytes(self.buffer))
        self.file.write(packed)
        self.sizes.append((len(packed), len(self.buffer)))
        self.written += len(packed)
        self.buffer.clear()

    def close(self) -> None:
        if self.buffer:
            self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()


def seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """Of each frame of an open bundle: offset, compressed and plain size."""
    file.seek(size - 9)
    frames, descriptor, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    entry = 12 if descriptor & 0x80 else 8
    file.seek(size - 9 - frames * entry)
    raw, out, at = file.read(frames * entry), [], 0
    for k in range(frames):
        packed, plain = struct.unpack_from("<II", raw, k * entry)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(file, frame: tuple[int, int, int]) -> bytes:
    import zstandard

    file.seek(frame[0])
    return zstandard.ZstdDecompressor().decompress(file.read(frame[1]), max_output_size=frame[2])


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}")


def revisits(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """(page, digest, keeper) of the pages that another one with an equal payload stands for."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    slim = pages.where(F.octet_length(payload) >= revisit_bytes).select(F.col("page_id").alias("_page"), F.unhex(F.sha1(payload)).alias("_sha1"))
    slim = materialize(slim, "warc-digests")
    shared = materialize(slim.groupBy("_sha1").agg(F.max("_page").alias("_keeper"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "warc-shared")
    return slim.join(shared, "_sha1").where("_page != _keeper").select("_page", "_sha1", "_keeper").distinct()


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per row into bundles under ``path``; the index (also written there): ``page_id``, ``record_id``, ``bundle``, ``frame``, ``offset``, ``length``."""
    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    marks = materialize(revisits(chosen, revisit_bytes), "warc-revisits")
    digest = F.unhex(F.sha1(F.coalesce("html", F.lit(""))))
    marked = chosen.withColumn("_digest", digest).join(marks, (F.col("page_id") == F.col("_page")) & (F.col("_digest") == F.col("_sha1")), "left").select("page_id", "url", "html", "_keeper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        writer, bundle, rows = None, "", []

        def close() -> pa.RecordBatch:
            nonlocal writer
            writer.close()
            writer = None
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["page_id", "record_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for page, url, html, keeper in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if writer is None:
                    bundle = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(store.open_output_stream(f"{folder}/{bundle}", compression=None), frame_bytes)
                record = make_record(page, url, (html or "").encode("utf-8", "surrogatepass"), keeper)
                rows.append((page, record_id(page), bundle, *writer.add(record), len(record)))
                if writer.written + len(writer.buffer) >= bundle_bytes:
                    yield close()
        if writer is not None:
            yield close()

    index = marked.mapInArrow(run, "page_id long, record_id string, bundle string, frame int, offset long, length long")
    index.write.parquet(f"{path}/index")
    return pages.sparkSession.read.schema(index.schema).parquet(f"{path}/index")


def read_archives(index: DataFrame, path: str, *, with_payload: bool = False) -> DataFrame:
    """Read every record of the bundles that ``index`` names: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, and ``payload`` if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())[: 6 if with_payload else 5]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: len(kinds)]
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                with store.open_input_file(f"{folder}/{bundle}") as file:
                    for frame in seek_table(file, file.size()):
                        rows = [read_back(headers, block) for _, headers, block in parse_records(read_frame(file, frame))]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    bundles = materialize(index.select("bundle").distinct(), "warc-bundles")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return bundles.repartition(max(1, int(bundles.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, schema)


def fetch(path: str, bundle: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, reading its frame alone."""
    store, folder = _store(path)
    with store.open_input_file(f"{folder}/{bundle}") as file:
        plain = read_frame(file, seek_table(file, file.size())[frame])
    _, headers, block = next(parse_records(plain[offset:]))
    return headers, block


def archive_round_trip(pages: DataFrame, spark: SparkSession, **how) -> DataFrame:
    """Write all pages into archives in the shared folder and read the archives back."""
    path = new_path(spark, "warc")
    return read_archives(write_archives(pages, path, **how), path)

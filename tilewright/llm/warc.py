"""WARC bundles of independent Zstandard frames with a seek table, written and read in parallel."""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .runtime import cut, new_path

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 32 << 20
#: Most tasks that bundles are dealt to.
MAX_TASKS = 20_000
INDEX = "page_id bigint, record_id string, bundle string, frame int, frame_at bigint, offset bigint, length bigint"


# -- storage -------------------------------------------------------------------------------


class Store:
    """Whole-file writes and ranged reads under a folder that all executors share."""

    def __init__(self, folder: str) -> None:
        parts = urlsplit(folder)
        self.local = parts.scheme in ("", "file")
        if self.local:
            self.root = parts.path
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(folder)

    def write(self, name: str, data: bytes) -> None:
        """The file appears whole or not at all."""
        part, whole = f"{self.root}/.{name}.part", f"{self.root}/{name}"
        if self.local:
            os.makedirs(self.root, exist_ok=True)
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, whole)
        else:
            self.fs.create_dir(self.root, recursive=True)
            with self.fs.open_output_stream(part) as f:
                f.write(data)
            self.fs.move(part, whole)

    def open(self, name: str):
        return open(f"{self.root}/{name}", "rb") if self.local else self.fs.open_input_file(f"{self.root}/{name}")


# -- records -------------------------------------------------------------------------------


def record(page_id: int | None, record_id: str, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit holds the payload's digest and size instead of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if " " < c != "\x7f" else "%%%02X" % ord(c) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {uri}"] if uri else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        *([f"WARC-Page-ID: {page_id}"] if page_id is not None else []),
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        *([f"WARC-Refers-To-Page-ID: {refers_to}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block, and where the next record starts."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    headers = dict(line.split(": ", 1) for line in lines)
    start = end + 4
    stop = start + int(headers["Content-Length"])
    return headers, data[start:stop], stop + 4


def payload_of(headers: dict[str, str], block: bytes) -> bytes | None:
    """The checked payload of a response; None for a revisit."""
    if headers["WARC-Type"] == "revisit":
        return None
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if "sha256:" + hashlib.sha256(payload).hexdigest() != headers["WARC-Payload-Digest"]:
        raise ValueError(f"payload digest differs in {headers['WARC-Record-ID']}")
    return payload


# -- bundles -------------------------------------------------------------------------------


class Bundle:
    """Frames being filled with whole records; ``finish`` appends the seek table."""

    def __init__(self, frame_bytes: int) -> None:
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=3, write_checksum=True).compress
        self.frame_bytes, self.out, self.open, self.table = frame_bytes, bytearray(), bytearray(), []

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame number, where the frame starts in the file, offset of the record in the frame)"""
        if self.open and len(self.open) + len(data) > self.frame_bytes:
            self.close_frame()
        at = len(self.table), len(self.out), len(self.open)
        self.open += data
        return at

    def close_frame(self) -> None:
        if self.open:
            frame = self.compress(bytes(self.open))
            self.table.append((len(frame), len(self.open)))
            self.out += frame
            self.open = bytearray()

    def finish(self) -> bytes:
        self.close_frame()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        return bytes(self.out) + struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def seek_table(f) -> list[tuple[int, int]]:
    """(where each frame starts, its compressed size), read from the footer alone."""
    f.seek(-9, 2)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    f.seek(-9 - n * width, 2)
    raw, at, out = f.read(n * width), 0, []
    for i in range(n):
        size = struct.unpack_from("<I", raw, i * width)[0]
        out.append((at, size))
        at += size
    return out


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, min_revisit: int = 100, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write every row as a WARC record; returns the index: page_id, record_id, bundle, frame, frame_at, offset, length.

    Of rows with equal payloads of at least ``min_revisit`` bytes, the one with the smallest id
    is a response and the others are revisits that refer to it; shorter payloads are always
    responses.  Rows that repeat the responding id with its payload are responses too, and where
    all ids of a group are null every row is one.  Null html is an empty payload.

    First pass: (digest, id) pairs are pre-aggregated; only groups of two or more are written
    and joined back to the rows by digest, from a plain scan, so that a hot payload's rows may
    be split among tasks.  Second pass: each task fills bundles of about ``bundle_bytes`` and
    holds no more than one.  A file appears whole under a name of its own attempt; the index,
    itself a written table, lists committed files only, so a retried task leaves at worst a file
    that nothing refers to.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("__id"), F.col(url_col).alias("__url"), html.alias("__html")).withColumn("__digest", F.sha2(F.col("__html").cast("binary"), 256))
    groups = rows.where(F.octet_length("__html") >= min_revisit).groupBy("__digest").agg(F.min("__id").alias("__first"), F.count("*").alias("__n")).where("__n > 1 and __first is not null")
    groups = cut(groups.select("__digest", "__first"), "warc-groups")
    decided = rows.join(groups, "__digest", "left").select(
        "__id", "__url", "__digest", F.when(F.col("__id").eqNullSafe(F.col("__first")), None).otherwise(F.col("__first")).alias("__to"), "__html"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, attempt = Store(folder), uuid.uuid4().hex
        bundle, index, done = Bundle(frame_bytes), [], 0

        def finish() -> pa.RecordBatch:
            nonlocal bundle, index, done
            name = f"{attempt}-{done:05d}.warc.zst"
            store.write(name, bundle.finish())
            cols = list(zip(*index, strict=True))
            out = pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array([name] * len(index), pa.string()), *(pa.array(c, t) for c, t in zip(cols[2:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))],
                names=["page_id", "record_id", "bundle", "frame", "frame_at", "offset", "length"],
            )
            bundle, index, done = Bundle(frame_bytes), [], done + 1
            return out

        for batch in slices(batches, "__html"):
            for page, url, digest, to, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = str(uuid.UUID(hashlib.md5(f"{attempt}:{done}:{len(index)}".encode()).hexdigest()))
                data = record(page, name, url, text.encode(), digest, to, to is not None)
                index.append((page, name, *bundle.add(data), len(data)))
                if len(bundle.out) + len(bundle.open) > bundle_bytes:
                    yield finish()
        if index:
            yield finish()

    return cut(decided.mapInArrow(run, INDEX), "warc-index")


_READ = "page_id bigint, record_id string, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    cols = zip(*found, strict=True) if found else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])


def _row(headers: dict[str, str], block: bytes) -> tuple:
    page, to = headers.get("WARC-Page-ID"), headers.get("WARC-Refers-To-Page-ID")
    return (
        None if page is None else int(page),
        headers["WARC-Record-ID"][10:-1],
        headers.get("WARC-Target-URI"),
        headers["WARC-Type"],
        headers["WARC-Payload-Digest"].removeprefix("sha256:"),
        int(headers["WARC-Payload-Length"]),
        None if to is None else int(to),
        payload_of(headers, block),
    )


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the bundles that ``index`` lists, frame by frame; payload is null for revisits.

    Payload digests are checked while reading.  Bundles are dealt to tasks by name, one or a few
    to each; the number of tasks is set from the number of bundles, since their names are too
    short for adaptive execution to see how much work they are.
    """
    names = cut(index.select("bundle").distinct(), "warc-bundles")
    tasks = min(max(names.count(), 1), MAX_TASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip, store = zstandard.ZstdDecompressor().decompress, Store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open(name) as f:
                    for at, size in seek_table(f):
                        f.seek(at)
                        data, here, found = unzip(f.read(size)), 0, []
                        while here < len(data):
                            headers, block, here = parse(data, here)
                            found.append(_row(headers, block))
                        yield _rows(found)

    return names.repartition(tasks, "bundle").mapInArrow(run, _READ)


def fetch_records(wanted: DataFrame, folder: str) -> DataFrame:
    """The records that rows of the index name, each by one seek and one frame; rows of a frame in a task share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip, store, last, data = zstandard.ZstdDecompressor().decompress, Store(folder), None, b""
        for batch in batches:
            found = []
            for name, at, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (name, at) != last:
                    with store.open(name) as f:
                        size = dict(seek_table(f))[at]
                        f.seek(at)
                        data, last = unzip(f.read(size)), (name, at)
                headers, block, _ = parse(data, offset)
                found.append(_row(headers, block))
            yield _rows(found)

    return wanted.select("bundle", "frame_at", "offset").repartition("bundle", "frame_at").sortWithinPartitions("bundle", "frame_at", "offset").mapInArrow(run, _READ)


def archive_folder(spark) -> str:
    return new_path(spark, "warc")

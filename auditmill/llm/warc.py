"""WARC archives in seekable Zstandard bundles (operator 11).

Records are grouped into frames of about FRAME_BYTES; each frame is compressed on its own. A bundle is a file of frames
that ends with a seek table in a skippable frame (the public "Zstandard seekable format": per frame its compressed and
plain length and a checksum), so any Zstandard reader can unpack a bundle as a whole and a record costs one frame. The
index maps a record's identifier to its bundle, frame, offset within the plain frame and length.

Tasks write bundles side by side and return index rows only once a bundle is closed. A file is named by its attempt, so
what a lost or doubled attempt leaves behind is in no index. Folders are those that Arrow's file systems open.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditmill.llm.batches import bound_batches
from auditmill.session import shared_folder, store
from auditmill.sources.files import open_path

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 27
BUNDLE_RECORDS = 100_000   # index rows a task holds until its bundle is closed
TASK_BYTES = 1 << 26       # plain bytes that a task reads back; rows of places are too small to deal out by their own size
LEAST_SHARED = 100         # bytes of a payload that revisits may stand for
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"

# Fixed values of the two public formats.
SEEK_FRAME, SEEK_FOOTER = 0x184D2A5E, 0x8F92EAB1
HAS_CHECKSUMS = 0x80
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ENTRY, _FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
_LOWEST = bytes(range(33)) + b"\x7f"


def _uri(text: str) -> str:
    """White space and control characters, which a header cannot hold, percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 128 and ord(c) in _LOWEST else c for c in text)


def record_id(page: str | None, uid: str) -> str:
    return f"urn:x-row:{uid}" if page is None else f"urn:x-page:{quote(page, safe='')}:{uid}"


def page_of(identifier: str) -> str | None:
    parts = identifier.split(":")
    return unquote(parts[2]) if parts[1] == "x-page" else None


def record(identifier: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, size: int) -> bytes:
    """A response with its payload, or a revisit with the HTTP head only; `size` is that of the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{identifier}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _uri(url)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", SAME_PAYLOAD)]
    block = head if refers_to else head + payload
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _header(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Fields of the header that begins after the line at `at`, and the first byte after it."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines), end + 4


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at a place of a plain frame and the place after it; a damaged one raises."""
    if not data.startswith(VERSION, at):
        raise ValueError(f"no record at byte {at}")
    fields, block = _header(data, at)
    end = block + int(fields["Content-Length"])
    http, body = _header(data, block)
    refers = fields.get("WARC-Refers-To")
    found = {"record_id": fields["WARC-Record-ID"].strip("<>"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
             "refers_to": refers and refers.strip("<>"), "payload_bytes": int(http["Content-Length"]),
             "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "payload": None if refers else data[body:end]}
    if not refers:
        sha = hashlib.sha256(memoryview(data)[body:end]).hexdigest()
        if sha != found["payload_digest"] or end - body != found["payload_bytes"]:
            raise ValueError(f"payload of {found['record_id']} does not match its digest")
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError(f"record {found['record_id']} has no end")
    return found, end + 4


class Bundle:
    """A bundle being written: records go into the open frame, frames into the file, the seek table at the end."""

    def __init__(self, path: str, frame_bytes: int) -> None:
        self.path, self.frame_bytes = path, frame_bytes
        fs, inner = open_path(path)
        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.stream = fs.open_output_stream(inner, compression=None)  # the file is packed already
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.entries: list[tuple[int, int, int]] = []
        self.plain, self.size, self.written = [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset) of the record."""
        if self.size and self.size + len(data) > self.frame_bytes:
            self.end_frame()
        at = self.size
        self.plain.append(data)
        self.size += len(data)
        return len(self.entries), at

    def end_frame(self) -> None:
        plain = b"".join(self.plain)
        packed = self.packer.compress(plain)
        self.stream.write(packed)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.written += len(packed)
        self.plain, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self.end_frame()
        table = b"".join(_ENTRY.pack(*e) for e in self.entries) + _FOOTER.pack(len(self.entries), HAS_CHECKSUMS, SEEK_FOOTER)
        self.stream.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)
        self.stream.close()


def seek_table(path: str) -> list[tuple[int, int, int, int]]:
    """(first byte, compressed length, plain length, checksum) of each frame of a bundle."""
    fs, inner = open_path(path)
    with fs.open_input_file(inner) as file:
        size = file.size()
        count, flags, magic = _FOOTER.unpack(file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != SEEK_FOOTER or flags != HAS_CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        length = count * _ENTRY.size + _FOOTER.size
        entries = file.read_at(count * _ENTRY.size, size - length)
    found, at = [], 0
    for packed, plain, checksum in _ENTRY.iter_unpack(entries):
        found.append((at, packed, plain, checksum))
        at += packed
    return found


class _Reader:
    """Frames of bundles by place; the last file stays open."""

    def __init__(self) -> None:
        self.path, self.file, self.unpacker = None, None, zstandard.ZstdDecompressor()

    def frame(self, path: str, at: int, packed: int, plain: int, checksum: int) -> bytes:
        if path != self.path:
            self.close()
            fs, inner = open_path(path)
            self.path, self.file = path, fs.open_input_file(inner)
        data = self.unpacker.decompress(self.file.read_at(packed, at), max_output_size=plain)
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame at byte {at} of {path} is damaged")
        return data

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


INDEX = "record_id string, page string, record_type string, bundle string, frame int, offset int, length int"
_INDEX = [("record_id", pa.string()), ("page", pa.string()), ("record_type", pa.string()), ("bundle", pa.string()),
          ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]


def _writer(folder: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, rows = None, []

        def close() -> pa.RecordBatch:
            bundle.close()
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _INDEX)], names=[n for n, _ in _INDEX])
            rows.clear()
            return out

        for batch in batches:
            for uid, page, url, payload, digest, size, first_uid, first_page in zip(*[batch.column(i).to_pylist() for i in range(8)]):
                if bundle is None:
                    bundle = Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst", frame_bytes)
                refers = record_id(first_page, first_uid) if first_uid is not None else None
                own = record_id(page, uid)
                data = record(own, url, payload, digest, refers, size)
                frame, at = bundle.add(data)
                rows.append((own, page, "revisit" if refers else "response", bundle.path, frame, at, len(data)))
                if bundle.written >= bundle_bytes or len(rows) >= BUNDLE_RECORDS:
                    yield close()
                    bundle = None
        if bundle is not None:
            yield close()

    return run


_RECORD = [("record_id", pa.string()), ("page", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
           ("refers_page", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
RECORD = ("record_id string, page string, url string, record_type string, refers_to string, refers_page string, "
          "payload_bytes long, payload_digest string, payload binary")


def _batch(records: list[dict], with_payload: bool) -> pa.RecordBatch:
    for r in records:
        r["page"], r["refers_page"] = page_of(r["record_id"]), r["refers_to"] and page_of(r["refers_to"])
        if not with_payload:
            r["payload"] = None
    return pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in records], t) for n, t in _RECORD})


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The seek tables of bundles as rows."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            table = seek_table(path)
            columns = list(zip(*table)) or [[]] * 4
            n = len(table)
            yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(n), pa.int32()), *[pa.array(c, pa.int64()) for c in columns]],
                                             names=["bundle", "frame", "at", "packed", "plain", "checksum"])


def _records(with_payload: bool):
    """All records of frames."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            for path, at, packed, plain, checksum in zip(*[batch.column(c).to_pylist() for c in ("bundle", "at", "packed", "plain", "checksum")]):
                data, place, found = reader.frame(path, at, packed, plain, checksum), 0, []
                while place < len(data):
                    one, place = parse(data, place)
                    found.append(one)
                yield _batch(found, with_payload)
        reader.close()

    return run


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records at given places; rows of a frame come one after the other and unpack it once."""
    reader, tables, last, data = _Reader(), {}, None, b""
    for batch in batches:
        found = []
        for path, frame, offset in zip(*[batch.column(c).to_pylist() for c in ("bundle", "frame", "offset")]):
            if (path, frame) != last:
                if path not in tables:
                    tables = {path: seek_table(path)}
                data, last = reader.frame(path, *tables[path][frame]), (path, frame)
            found.append(parse(data, offset)[0])
        if found:
            yield _batch(found, True)
    reader.close()


@dataclass
class Archive:
    """index: (record_id, page, record_type, bundle, frame, offset, length), stored as Parquet; bundles lie in `folder`."""

    index: DataFrame
    folder: str

    def records(self, with_payload: bool = True) -> DataFrame:
        """All records, read back from the bundles by their seek tables: a frame is the unit of work. Payloads are checked
        against their digests; revisits have none (null)."""
        frames = store(self.index.select("bundle").distinct().mapInArrow(_frames, "bundle string, frame int, at long, packed long, plain long, checksum long"))
        plain = frames.agg(F.sum("plain")).first()[0] or 0
        tasks = max(frames.sparkSession.sparkContext.defaultParallelism, -(-plain // TASK_BYTES))
        return frames.repartition(tasks, "bundle", "frame").mapInArrow(_records(with_payload), RECORD)

    def fetch(self, identifiers: DataFrame) -> DataFrame:
        """The records whose `record_id` is among the identifiers, reading only their frames."""
        wanted = store(self.index.join(identifiers.select("record_id").distinct(), "record_id", "left_semi").select("bundle", "frame", "offset", "length"))
        size = wanted.agg(F.sum("length")).first()[0] or 0
        tasks = max(wanted.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
        return wanted.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(_picked, RECORD)


def write(pages: DataFrame, folder: str | None = None, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
          uid: Column | None = None, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> Archive:
    """Write one record a row.

    Of equal payloads of LEAST_SHARED bytes or more the row with the smallest id (nulls last; equal ids: the least `uid`)
    is a response, the others are revisits of it; smaller payloads are all responses. `uid` is a column expression that
    tells rows apart and stays the same when `pages` is read again, as a file's path and row number do; without one the
    rows are stored once with a number. Null payloads are empty, null urls and ids are left out of the record, white space
    and control characters of a url are percent-encoded; repeated rows are records of their own, an empty table gives an
    empty index. A payload is held whole by the task that writes or reads it. Other columns are not looked at."""
    spark = pages.sparkSession
    bound_batches(spark)
    folder = folder or f"{shared_folder(spark)}/auditmill/{uuid.uuid4().hex}"
    if uid is None:
        pages = store(pages.select(F.col(id_column), F.col(url_column), F.col(payload_column), F.monotonically_increasing_id().cast("string").alias("_uid_")))
        uid = F.col("_uid_")
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b""))
    rows = pages.select(uid.alias("uid"), F.col(id_column).alias("id"), F.col(url_column).alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    small = store(rows.filter(F.col("size") >= LEAST_SHARED).select("uid", "id", "digest"))
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")).alias("first")
    firsts = small.groupBy("digest").agg(least, F.count("*").alias("n")).filter("n > 1")
    revisits = store(small.join(firsts, "digest").filter("uid <> first.uid")
                     .select("uid", F.col("first.uid").alias("first_uid"), F.col("first.id").cast("string").alias("first_page")))
    marked = rows.join(revisits, "uid", "left")
    body = F.when(F.col("first_uid").isNull(), F.col("payload")).otherwise(F.lit(b""))
    records = marked.select("uid", F.col("id").cast("string"), "url", body, "digest", "size", "first_uid", "first_page")
    return Archive(store(records.mapInArrow(_writer(folder, frame_bytes, bundle_bytes), INDEX)), folder)


def summary(records: DataFrame, id_type: str = "long", id_column: str = "page_id") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of records; refers_to is the id of the response."""
    return records.select(F.col("page").cast(id_type).alias(id_column), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_page").cast(id_type).alias("refers_to"))

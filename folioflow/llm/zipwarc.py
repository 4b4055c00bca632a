"""WARC records in ZIP archives: written by Spark, read by byte ranges through the central directory.

An archive is a ZIP file of stored (uncompressed) members: archive/data.warc.gz, one gzip member per record, and
indexes/index.cdxj, one line per record with its place in the WARC member. The reader never extracts: it reads the end of
the file, follows the end record (and its ZIP64 form) to the central directory, finds the stored members and, through
the index, reads each record's range.

Files are written by Spark's own writer, so that any Hadoop file system and its committer serve: a row holds an archive's
bytes, its partition column makes the file, and the line end that the text writer adds is declared as the ZIP comment.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payload bytes from which an archive is closed.
ARCHIVE_BYTES = 8 << 20
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_LOCAL, _CENTRAL, _END, _END64, _PLACE64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_BIG = 0xFFFFFFFF


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- ZIP


def zip_bytes(members: list[tuple[str, bytes]], comment: bytes = b"\n", zip64: bool = False) -> bytes:
    """A ZIP file of stored members; the ZIP64 forms are used where a number needs them, or always if zip64."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        at, crc, n = len(out), zlib.crc32(data), len(data)
        wide = zip64 or n >= _BIG or at >= _BIG
        extra = struct.pack("<HHQQ", 1, 16, n, n) if wide else b""
        short = _BIG if wide else n
        raw = name.encode()
        out += _LOCAL + struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if wide else b""
        central += _CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, _BIG if wide else at) + raw + extra
    at, n, size = len(out), len(members), len(central)
    out += central
    if zip64 or at >= _BIG or size >= _BIG or n >= 0xFFFF:
        end = len(out)
        out += _END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, at)
        out += _PLACE64 + struct.pack("<IQI", 0, end, 1)
        n, size, at = 0xFFFF, _BIG, _BIG
    out += _END + struct.pack("<HHHHIIH", 0, 0, n, n, size, at, len(comment)) + comment
    return bytes(out)


class Range:
    """Byte ranges of a file: a path or URI of any file system that pyarrow opens, or bytes already here."""

    def __init__(self, source: str | bytes) -> None:
        if isinstance(source, str):
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(source) if "://" in source else (fs.LocalFileSystem(), source)
            self.file, self.size = system.open_input_file(path), system.get_file_info(path).size
        else:
            self.file, self.size = pa.BufferReader(source), len(source)

    def read(self, start: int, length: int) -> bytes:
        if start < 0 or length < 0 or start + length > self.size:
            raise ValueError(f"range {start}+{length} outside a file of {self.size} bytes")
        return self.file.read_at(length, start)


def directory(file: Range) -> dict[str, tuple[int, int]]:
    """name: (offset, length) of the data of every stored member, from the central directory."""
    tail_at = max(0, file.size - 65557)
    tail = file.read(tail_at, file.size - tail_at)
    end = tail.rfind(_END)
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(_END, 0, end)  # the signature may stand in a comment
    if end < 0:
        raise ValueError("no end of central directory")
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or _BIG in (size, at):
        place = file.read(tail_at + end - 20, 20)
        if place[:4] == _PLACE64:
            wide = file.read(struct.unpack_from("<Q", place, 8)[0], 56)
            if wide[:4] != _END64:
                raise ValueError("no ZIP64 end of central directory")
            count, size, at = struct.unpack_from("<QQQ", wide, 32)
    data, p, out = file.read(at, size), 0, {}
    for _ in range(count):
        if data[p : p + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", data, p + 10)
        packed, full, n, m, k = struct.unpack_from("<IIHHH", data, p + 20)
        offset, = struct.unpack_from("<I", data, p + 42)
        name, extra = data[p + 46 : p + 46 + n].decode("utf-8", "replace"), data[p + 46 + n : p + 46 + n + m]
        while len(extra) >= 4:
            tag, length = struct.unpack_from("<HH", extra)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                full = wide.pop(0) if full == _BIG else full
                packed = wide.pop(0) if packed == _BIG else packed
                offset = wide.pop(0) if offset == _BIG else offset
            extra = extra[4 + length :]
        if method == 0 and packed == full:
            head = file.read(offset, 30)
            if head[:4] != _LOCAL:
                raise ValueError(f"no member at {offset}")
            out[name] = (offset + 30 + sum(struct.unpack_from("<HH", head, 26)), full)
        p += 46 + n + m + k
    return out


# ---- WARC


def record_bytes(page_id: int, url: str | None, kind: str, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One WARC record, gzipped on its own. A revisit has the headers only; X-Payload-Length keeps its payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if kind == "response" else b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 3, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-cased names, payload after the HTTP head) of one gzipped record."""
    data = gzip.decompress(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict((k.lower(), v) for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:]))
    return fields, rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]


def records(file: Range, block: int = 4 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record that the archive's index names, read by its range; neighbours share a read of about `block` bytes."""
    members = directory(file)
    lines = file.read(*members[INDEX]).decode().splitlines()
    base = members[WARC][0]
    places = sorted((x["offset"], x["length"]) for x in (json.loads(line.partition(" ")[2]) for line in lines))
    held_at, held = 0, b""
    for offset, length in places:
        if offset + length > held_at + len(held) or offset < held_at:
            held_at, held = offset, file.read(base + offset, min(max(block, length), members[WARC][1] - offset))
        yield parse_record(held[offset - held_at : offset - held_at + length])


# ---- on Spark


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes the WARC archives of pages (page_id, url, html) below path, as archive=<n>/*.

    Of pages with equal payloads (UTF-8 of html, null as empty) of at least min_bytes, that with the largest page_id is a
    response and the others are revisits of it; smaller payloads are always responses. Null ids are less than any other. Rows
    that share the largest id too, as repeated rows do, are responses alike. A hot payload is counted before it is
    shuffled, and its rows need not meet: the join's partition can be split. Very long
    payloads are records of their own; an empty table writes nothing; other columns, whatever their names, are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    ids = pages.select(F.col("page_id").cast("long").alias("page_id"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    each = ids.where(F.octet_length("payload") >= min_bytes).select("page_id", F.unhex(F.sha1("payload")).alias("sha1"))
    last = F.max(F.struct(F.col("page_id").isNotNull().alias("named"), "page_id", F.lit(1).alias("one")))
    groups = each.groupBy("sha1").agg(last.alias("last"), F.count("*").alias("copies")).where("copies > 1").select("sha1", "last.page_id", F.lit(True).alias("copied")).withColumnRenamed("page_id", "last")
    marked = rows.join(groups, "sha1", "left")
    first = F.col("copied").isNull() | F.col("page_id").eqNullSafe(F.col("last"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, size, held, index, seen = TaskContext.get().partitionId(), 0, 0, bytearray(), [], 0

        def close() -> pa.RecordBatch:
            name = (part << 24) | n
            data = zip_bytes([(WARC, bytes(held)), (INDEX, "".join(index).encode())], b"\n")[:-1]  # the text writer ends the line
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], names=["archive", "value"])

        for batch in batches:
            for sha1, page, url, payload, last, first in zip(*(c.to_pylist() for c in batch.columns)):
                name = base64.b32encode(sha1).decode()
                kind = "response" if first else "revisit"
                record = record_bytes(page, url, kind, payload, name, last)
                index.append(f"{page} " + json.dumps({"offset": len(held), "length": len(record), "digest": name}) + "\n")
                held += record
                seen += 1
                if len(held) >= ARCHIVE_BYTES:
                    yield close()
                    n, held, index, seen = n + 1, bytearray(), [], 0
        if seen:
            yield close()

    out = marked.select("sha1", "page_id", "url", "payload", "last", first.alias("first")).mapInArrow(archives, "archive long, value binary")
    out.select("archive", F.col("value").cast("string").alias("value")).write.partitionBy("archive").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below path: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    payload_bytes and payload_digest are the whole payload's; payload is null for a revisit, page_id and refers_to where they were
    null. Files are listed by Spark; executors open them by ranges where pyarrow knows the file system, else Spark reads them
    whole. Blanks and other characters of a path may be encoded; an archive without a record gives no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    direct = path.split(":")[0] in ("file", "s3", "s3a", "gs", "hdfs") or path.startswith("/")

    def opened(place: str) -> str:
        """A path or URI as pyarrow takes it."""
        if place.startswith("file:"):
            return unquote(re.sub("^file:/+", "/", place))
        return re.sub("^s3a:", "s3:", place)
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size = [], 0
                for head, payload in records(Range(opened(place) if content is None else content)):
                    number = lambda k: int(found[1]) if (found := re.search("([0-9-]+)>$", head.get(k, ""))) else None
                    response = head["warc-type"] == "response"
                    name = head["warc-payload-digest"].removeprefix("sha1:")
                    if response and (digest(payload) != name or len(payload) != int(head["x-payload-length"])):
                        raise ValueError(f"record {head['warc-record-id']} of {place} does not hold its payload")
                    rows.append((number("warc-record-id"), head["warc-target-uri"], head["warc-type"], int(head["x-payload-length"]), name, number("warc-refers-to"), payload if response else None))
                    size += len(payload)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.select("path", "content" if not direct else F.lit(None).cast("binary").alias("content")).mapInArrow(read, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

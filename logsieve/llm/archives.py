"""WARC records inside ZIP packages, read by range without extraction.

A package is a ZIP file with two stored members: ``archive/data.warc.gz``, records that are gzip
members of their own, and ``indexes/index.cdx``, one line for each record with its place in the
first. The reader takes the end of the file, follows the (ZIP64) end record to the central directory,
finds stored members, and reads the ranges it needs; nothing is unpacked to disk.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.batches import small_batches
from logsieve.llm.files import attempt_name, new_folder, open_folder
from logsieve.sources.sinks import stage

#: Fixed values of the ZIP format: signatures, the marker of a 64-bit value, the longest tail.
LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END64, LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
HUGE, HUGE_COUNT, TAIL = 0xFFFFFFFF, 0xFFFF, 65_557
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Fixed values of records: the profile of a repeated payload, the answer that holds a payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
#: Payloads below this many bytes are never revisits; record bytes that one reading task takes on.
LEAST, RANGE_BYTES = 100, 16_000_000
#: Repeated digests (about 100 bytes each) that are sent to every task; more are met by a join.
SENT = 200_000


class Member(NamedTuple):
    name: str
    method: int
    offset: int
    size: int
    crc: int


class BadArchive(ValueError):
    """A package whose directory or records do not hold together."""


def _extra64(extra: bytes, values: list[int]) -> list[int]:
    """Replaces marked 32-bit values by those of the ZIP64 extra field, in their order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(wide) if v == HUGE else v for v in values]
        at += 4 + size
    return values


def read_directory(source, size: int) -> list[Member]:
    """The members of a ZIP file, from its central directory; offsets are those of local headers."""
    start = max(0, size - TAIL)
    source.seek(start)
    tail = source.read(size - start)
    at = tail.rfind(END)
    if at < 0:
        raise BadArchive("no end record")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if HUGE in (length, offset) or count == HUGE_COUNT:
        if at < 20 or tail[at - 20 : at - 16] != LOCATOR64:
            raise BadArchive("no 64-bit locator")
        (place,) = struct.unpack_from("<Q", tail, at - 12)
        source.seek(place)
        record = source.read(56)
        if record[:4] != END64:
            raise BadArchive("no 64-bit end record")
        count, length, offset = struct.unpack_from("<QQQ", record, 32)
    source.seek(offset)
    directory = source.read(length)
    members, at = [], 0
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise BadArchive("central directory")
        method, crc, packed, plain, name, extra, comment = struct.unpack_from("<H4xIIIHHH", directory, at + 10)
        (local,) = struct.unpack_from("<I", directory, at + 42)
        field = directory[at + 46 + name : at + 46 + name + extra]
        plain, packed, local = _extra64(field, [plain, packed, local])
        members.append(Member(directory[at + 46 : at + 46 + name].decode(), method, local, packed, crc))
        at += 46 + name + extra + comment
    return members


def member_start(source, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise BadArchive(f"{member.name} is not stored")
    source.seek(member.offset)
    head = source.read(30)
    if head[:4] != LOCAL:
        raise BadArchive("local header")
    name, extra = struct.unpack_from("<HH", head, 26)
    return member.offset + 30 + name + extra


class PackageWriter:
    """Writes stored members to a stream that cannot seek: sizes follow each member's bytes.

    Every size and offset is given as a 64-bit value, so packages may grow beyond 4 GB.
    """

    def __init__(self, out):
        self.out, self.at, self.done = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.start, self.crc, self.size = name.encode(), self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 8, 0, 0, 0x21, 0, HUGE, HUGE, len(self.name), len(extra)) + self.name + extra)

    def write(self, data: bytes) -> int:
        """Where the data lies in the member."""
        place, self.size, self.crc = self.size, self.size + len(data), zlib.crc32(data, self.crc)
        self._put(data)
        return place

    def end(self) -> None:
        self._put(b"PK\x07\x08" + struct.pack("<IQQ", self.crc, self.size, self.size))
        self.done.append((self.name, self.start, self.crc, self.size))

    def close(self) -> None:
        offset = self.at
        for name, start, crc, size in self.done:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start)
            self._put(
                CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8, 0, 0, 0x21, crc, HUGE, HUGE, len(name), len(extra), 0, 0, 0, 0, HUGE)
                + name + extra
            )
        length, place = self.at - offset, self.at
        n = len(self.done)
        self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, offset))
        self._put(LOCATOR64 + struct.pack("<IQI", 0, place, 1))
        self._put(END + struct.pack("<HHHHIIH", 0, 0, HUGE_COUNT, HUGE_COUNT, HUGE, HUGE, 0))


def _record(row, date: str) -> bytes:
    payload = (row.html or "").encode("utf-8", "surrogatepass")
    revisit = row.refers_to is not None and row.refers_to == row.refers_to
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{row.page_id}>",
        f"WARC-Target-URI: {(row.url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha256:{row.digest}",
        f"WARC-Date: {date}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{int(row.refers_to)}>", f"WARC-Profile: {PROFILE}"]
        block = b""
    else:
        block = HTTP.format(len(payload)).encode() + payload
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return zlib_member("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n")


def zlib_member(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(folder: str, date: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = open_folder(folder)
        files.create_dir(root, recursive=True)
        name, index, size = attempt_name("pages", ".zip"), [], 0
        with files.open_output_stream(f"{root}/{name}") as out:
            package = PackageWriter(out)
            package.begin(DATA)
            for batch in batches:
                for row in batch.itertuples(index=False):
                    data = _record(row, date)
                    index.append(f"{row.page_id} {package.write(data)} {len(data)}\n")
            package.end()
            package.begin(INDEX)
            package.write("".join(index).encode())
            package.end()
            package.close()
            size = package.at
        if index:
            yield pd.DataFrame({"file": [name], "n_records": [len(index)], "n_bytes": [size]})
        else:
            files.delete_file(f"{root}/{name}")

    return run


def write_archives(pages: DataFrame, folder: str | None = None, date: str | None = None) -> tuple[str, DataFrame]:
    """Writes one WARC record for each row of ``pages`` (page_id, url, html) into packages.

    Returns the folder and its manifest ``file, n_records, n_bytes``. Of the records whose payload
    of at least ``LEAST`` bytes is the same, that of the smallest page_id is a response and the
    others revisit it. A null html is an empty payload, a null url an empty one; rows with a null
    page_id have no record; of rows that repeat a page_id each has its record, and the copies of a
    leading page are responses like it. Other columns are ignored. No rows give no packages.
    ``date`` is every record's (UTC, as 2024-01-31T12:00:00Z), the time of the call if not given.

    Digests are reduced to their smallest page_id before the shuffle. Those of several pages go to
    every task if they are few; beyond, pages move once, in a join whose large keys may be split.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").where("page_id IS NOT NULL")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = rows.withColumn("digest", F.sha2(payload, 256)).withColumn("size", F.octet_length(payload))
    first = (
        rows.where(F.col("size") >= LEAST).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where("first != last").drop("last")
    )
    first = stage(first)
    if first.count() <= SENT:
        first = F.broadcast(first)
    marked = rows.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest",
        F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"),
    )
    folder = folder or new_folder(pages.sparkSession, "archives")
    date = date or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    manifest = marked.mapInPandas(_writer(folder, date), "file string, n_records long, n_bytes long")
    return folder, stage(manifest)


def _locate(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = open_folder(folder)
        for batch in batches:
            for file in batch["file"]:
                with files.open_input_file(f"{root}/{file}") as source:
                    members = {m.name: m for m in read_directory(source, source.size())}
                    index = members[INDEX]
                    source.seek(member_start(source, index))
                    lines = source.read(index.size)
                    if zlib.crc32(lines) != index.crc:
                        raise BadArchive("index checksum")
                    begin = member_start(source, members[DATA])
                spans: list[list[int]] = []
                for line in lines.decode().splitlines():
                    _, at, size = map(int, line.split())
                    if spans and spans[-1][1] + size <= RANGE_BYTES:
                        spans[-1][1] += size
                        spans[-1][2].append(size)
                    else:
                        spans.append([begin + at, size, [size]])
                yield pd.DataFrame([(file, *span) for span in spans], columns=["file", "offset", "size", "sizes"])

    return run


def _split(data: bytes, sizes) -> Iterator[bytes]:
    """The records of a range, cut by the lengths that the index gives."""
    at = 0
    for size in sizes:
        unpacker = zlib.decompressobj(31)
        record = unpacker.decompress(data[at : at + size])
        if not unpacker.eof or unpacker.unused_data:
            raise BadArchive("records of a range")
        yield record
        at += size
    if at != len(data):
        raise BadArchive("length of a range")


def parse_record(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    payload = rest[:size]
    if version != "WARC/1.1" or len(rest) != size + 4:
        raise BadArchive("record")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    refers_to = None
    if kind == "response":
        _, _, payload = payload.partition(b"\r\n\r\n")
        if hashlib.sha256(payload).hexdigest() != digest:
            raise BadArchive("payload digest")
    else:
        refers_to = int(fields["WARC-Refers-To"][10:-1])
    return (
        int(fields["WARC-Record-ID"][10:-1]), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]),
        digest, kind, refers_to, payload,
    )


COLUMNS = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]


def _read(folder: str, payloads: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = open_folder(folder)
        for batch in batches:
            for span in batch.itertuples(index=False):
                with files.open_input_file(f"{root}/{span.file}") as source:
                    data = source.read_at(span.size, span.offset)
                rows = [parse_record(r) for r in _split(data, span.sizes)]
                out = pd.DataFrame(rows, columns=COLUMNS).astype({"refers_to": "Int64"})
                yield out if payloads else out.drop(columns="payload")

    return run


def read_archives(folder: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` and ``payload`` per record.

    One task reads each package's directory and index; the records are then read by ranges of at
    most ``RANGE_BYTES``, dealt out anew, so a large package is not one task. A revisit has an empty
    payload and carries the full one's length and digest.
    """
    # Stated numbers: adaptive execution would put so few rows into one task.
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = manifest.select("file").repartition(parts, "file").mapInPandas(
        _locate(folder), "file string, offset long, size long, sizes array<long>"
    )
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spans.repartition(parts, "file", "offset").mapInPandas(
        _read(folder, payloads), kinds + ", payload binary" * payloads
    )

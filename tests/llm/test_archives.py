import hashlib
import io
import random
import zipfile
import zlib

import pytest

from logsieve.llm import archives as A

PAGES = "page_id long, url string, html string"


def brute(rows):
    first, out = {}, {}
    for page_id, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        body = (html or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        lead = first.setdefault(digest, page_id) if len(body) >= 100 else page_id
        out[page_id] = (len(body), digest, "response" if lead == page_id else "revisit", None if lead == page_id else lead)
    return out


def test_same_records_as_brute_force(spark):
    random.seed(1)
    bodies = ["x" * 99, "x" * 100, "é" * 50, "<html>" * 3000, None, "", "a\r\n\r\nWARC/1.1\r\n" * 20]
    rows = [(i, f"http://h/{i}\r\nX: y", random.choice(bodies)) for i in range(120)] + [(900, None, "u" * 500), (None, "n", "z" * 200)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], PAGES + ", digest string")
    folder, manifest = A.write_archives(pages)
    got = A.read_archives(folder, manifest).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == brute(rows)
    text = {r[0]: r[2] or "" for r in rows}
    assert all(bytes(r["payload"]).decode() == text[r["page_id"]] for r in got if r["record_type"] == "response")
    for row in manifest.collect():
        with zipfile.ZipFile(f"{folder.removeprefix('file://')}/{row['file']}") as z:
            assert z.testzip() is None and z.namelist() == [A.DATA, A.INDEX]


def test_repeated_rows_and_none(spark):
    rows = [(1, "u", "q" * 300), (1, "u", "q" * 300), (2, "u", "q" * 300)]
    folder, manifest = A.write_archives(spark.createDataFrame(rows, PAGES))
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in A.read_archives(folder, manifest).collect())
    assert got == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
    folder, manifest = A.write_archives(spark.createDataFrame([], PAGES))
    assert A.read_archives(folder, manifest).collect() == []


def test_reads_archives_of_another_writer():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
        z.writestr("é.txt", b"hello")
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"stored bytes")
        z.writestr(zipfile.ZipInfo("packed"), b"y" * 99, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    members = {m.name: m for m in A.read_directory(data, len(data.getvalue()))}
    at = A.member_start(data, members["big"])
    assert data.getvalue()[at : at + members["big"].size] == b"stored bytes"
    with pytest.raises(A.BadArchive):
        A.member_start(data, members["packed"])
    with pytest.raises(A.BadArchive):
        A.read_directory(io.BytesIO(b"not a zip"), 9)


def test_sizes_beyond_32_bits_come_from_the_extra_field():
    import struct

    big = 5 << 32
    extra = struct.pack("<HHB", 9, 1, 0) + struct.pack("<HHQQ", 1, 16, big, big + 1)
    assert A._extra64(extra, [A.HUGE, 7, A.HUGE]) == [big, 7, big + 1]


def test_records_are_complete_and_cut_in_linear_time():
    import time
    from types import SimpleNamespace

    row = SimpleNamespace(page_id=7, url="http://a/", html="<p>x</p>", digest="0", refers_to=None)
    head, _, block = zlib.decompress(A._record(row, "2024-01-31T12:00:00Z"), 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type"} <= set(fields)
    assert int(fields["Content-Length"]) == len(block) - 4 and block.startswith(b"HTTP/1.1 200") and block.endswith(b"<p>x</p>\r\n\r\n")
    row.refers_to = 3
    assert b"WARC-Profile: http" in zlib.decompress(A._record(row, "2024-01-31T12:00:00Z"), 31)
    one = A._record(row, "2024-01-31T12:00:00Z")
    started = time.time()
    assert sum(1 for _ in A._split(one * 50_000, [len(one)] * 50_000)) == 50_000
    assert time.time() - started < 10
    with pytest.raises(A.BadArchive):
        list(A._split(one + one, [len(one)]))

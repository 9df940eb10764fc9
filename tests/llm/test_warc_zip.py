import gzip
import hashlib
import io
import struct
import time
import zipfile

import pyarrow as pa
import pytest
from llm.conftest import rows_of

from boughs.llm import warc_zip

LONG = "<p>" + "häufig " * 200 + "</p>"


def _pages(spark):
    rows = [(i, f"http://h{i}.org/", LONG) for i in range(5)]
    rows += [(10, None, LONG + "x"), (11, "http://a\r\nb/", "short"), (12, "", "short"), (13, "u", None), (14, "u", "")]
    rows += [rows[1], rows[4], (None, "u", LONG), (None, None, None), (20, "u", "a" * 999), (21, "u", "a" * 999)]
    rows += [(22, "u", "b" * 1000), (23, "u", "b" * 1000), (24, "u", "\r\n\r\nWARC/1.1\r\n" + "c" * 3_000_000)]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, record_type string")


def _want(pages):
    rows, first, copies = pages.collect(), {}, {}
    for r in rows:
        p = (r.html or "").encode()
        copies[p] = copies.get(p, 0) + 1
        if r.page_id is not None:
            first[p] = max(first.get(p, r.page_id), r.page_id)
    out = []
    for r in rows:
        p = (r.html or "").encode()
        to = first.get(p) if len(p) >= 1000 and copies[p] > 1 and first.get(p) != r.page_id else None
        out.append((r.page_id, len(p), hashlib.sha1(p).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_round_trip(spark):
    pages = _pages(spark)
    out = warc_zip.archive_round_trip(spark, pages)
    assert rows_of(out, *COLUMNS) == _want(pages)
    for r in out.filter("record_type = 'response'").collect():
        assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest
    assert out.filter("record_type = 'revisit' and payload is not null").count() == 0
    assert out.filter("url = 'http://a%0D%0Ab/'").count() == 1


def test_small_archives_and_ranges(spark, tmp_path):
    pages = _pages(spark).repartition(2)
    archives = warc_zip.write_archives(warc_zip.page_records(pages), str(tmp_path / "a"), archive_bytes=300)
    assert archives.count() > 4
    got = warc_zip.read_archives(archives, range_bytes=100)
    assert got.count() == pages.count()
    assert sorted(got.columns) == sorted(warc_zip._RECORD.names)


def test_empty_table(spark):
    assert warc_zip.archive_round_trip(spark, _pages(spark).filter("false")).collect() == []


def _zip64(members):
    """An archive whose directory gives every size and offset as a 64-bit value."""
    body, directory = b"", b""
    for name, data in members:
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), len(body))
        other = struct.pack("<HH4s", 0x5455, 4, b"time")
        n = name.encode()
        directory += struct.pack("<4s4H2HIII5HII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF,
                                 len(n), len(other) + len(extra), 2, 0, 0, 0, 0xFFFFFFFF) + n + other + extra + b"hi"
        body += struct.pack("<4s5HIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(n), 7) + n + b"padding"
        body += data
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, len(members), len(members), len(directory), len(body))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(body) + len(directory), 1)
    end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 7) + b"comment"
    return body + directory + end64 + locator + end


def _record(i, text):
    payload = text.encode()
    return warc_zip.warc_record(f"urn:x:{i}", f"http://x/{i}", payload, hashlib.sha1(payload).hexdigest(), None)


def _read(spark, tmp_path, data, **options):
    path = tmp_path / "a.zip"
    path.write_bytes(data)
    return warc_zip.read_archives(spark.createDataFrame([(str(path),)], "path string"), **options)


def test_zip64_directory_with_two_data_members(spark, tmp_path):
    plain = b"".join(_record(i, f"plain {i}") for i in range(3))
    packed = [gzip.compress(_record(i, f"packed {i}")) for i in range(3, 6)]
    index, at = "", 0
    for p in packed:
        index += f"{at} {len(p)}\n"
        at += len(p)
    members = [("a/plain.warc", plain), ("readme.txt", b"hello"), ("b/x.warc.gz", b"".join(packed))]
    members.append(("b/x.warc.gz.cdx", index.encode()))
    data = _zip64(members)
    for size in (1, 1 << 20):
        got = _read(spark, tmp_path, data, range_bytes=size)
        want = sorted((f"urn:x:{i}", f"{'plain' if i < 3 else 'packed'} {i}".encode()) for i in range(6))
        assert sorted((r.record_id, bytes(r.payload)) for r in got.collect()) == want
    assert zipfile.ZipFile(io.BytesIO(data)).namelist() == [m[0] for m in members]


def test_cdxj_index_and_members_without_index(spark, tmp_path):
    packed = [gzip.compress(_record(i, f"text {i}" * 50)) for i in range(6)]
    places, at = [], 0
    for p in packed:
        places.append((at, len(p)))
        at += len(p)
    lines = [
        f'org,x)/{i} 19700101000000 {{"url": "http://x/{i}", "filename": "x.warc.gz", "offset": "{a}", "length": "{n}"}}\n'
        for i, (a, n) in reversed(list(enumerate(places)))
    ]
    index = ("!meta {}\n\n" + "".join(lines)).encode()
    want = sorted((f"urn:x:{i}", (f"text {i}" * 50).encode()) for i in range(6))
    data = ("archive/x.warc.gz", b"".join(packed))
    for n, extra in ((6, [("indexes/i.cdxj", index)]), (6, [("indexes/i.cdxj.gz", gzip.compress(index))]), (1, [])):
        path = tmp_path / "a.zip"
        path.write_bytes(_zip64([data, *extra]))
        batch = pa.RecordBatch.from_arrays([pa.array([str(path)])], names=["path"])
        ranges = next(iter(warc_zip._ranges(1)([batch])))
        assert ranges.num_rows == n and sum(ranges.column("length").to_pylist()) == at
        got = warc_zip.read_archives(spark.createDataFrame([(str(path),)], "path string"), range_bytes=1)
        assert sorted((r.record_id, bytes(r.payload)) for r in got.collect()) == want


@pytest.mark.parametrize("n", [1, 3, 7, 1000, 1 << 20])
def test_records_cut_anywhere(monkeypatch, n):
    monkeypatch.setattr(warc_zip, "FEED_BYTES", min(n, 1 << 14))
    monkeypatch.setattr(warc_zip, "PIECE_BYTES", n)
    texts = ["", "a\r\n\r\nb", "WARC/1.1\r\n\r\n", "x" * 3000, "é" * 500]
    records = [_record(i, t) for i, t in enumerate(texts)]
    many, one = b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records))
    for data in (b"".join(records), many, one):
        if data is many or data is one or n > 1:  # one byte does not tell gzip from plain data
            slices = [data[:2], *(data[i : i + n] for i in range(2, len(data), n))]
            got = [p.decode() for _, _, p in warc_zip.parse_records(warc_zip._unpacked(slices))]
            assert got == texts
        with pytest.raises(ValueError):
            list(warc_zip.parse_records(warc_zip._unpacked([data[:-20]])))


def test_unpacking_is_linear():
    """Small records: time goes with their number (about 0.15 s a MB; the bound leaves room for a busy machine)."""
    record = gzip.compress(_record(1, "short"))
    slow = {}
    for copies in (2_000, 16_000):
        begin = time.process_time()
        assert sum(1 for _ in warc_zip.parse_records(warc_zip._unpacked([record * copies]))) == copies
        slow[copies] = time.process_time() - begin
    assert slow[16_000] < 24 * slow[2_000]


def test_directory_matches_the_standard_library():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", b"first")
        z.writestr("ä/b.txt", b"second" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05 not the end"
    members = warc_zip.zip_members(pa.BufferReader(out.getvalue()))
    for info in zipfile.ZipFile(io.BytesIO(out.getvalue())).infolist():
        method, start, size = members[info.filename]
        assert (method, size) == (info.compress_type, info.compress_size)
    method, start, size = members["a.txt"]
    assert out.getvalue()[start : start + size] == b"first"


@pytest.mark.parametrize("change", ["cut", "compressed", "payload", "none"])
def test_damage_raises(spark, tmp_path, change):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        record = _record(1, "text").replace(b"text\r\n\r\n", b"tExt\r\n\r\n") if change == "payload" else _record(1, "text")
        z.writestr("a.warc", record, zipfile.ZIP_DEFLATED if change == "compressed" else zipfile.ZIP_STORED)
    data = {"cut": out.getvalue()[40:], "none": b"no archive"}.get(change, out.getvalue())
    with pytest.raises(Exception):  # noqa: B017
        _read(spark, tmp_path, data).collect()
